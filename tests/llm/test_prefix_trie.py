"""The trie of conversations against a plain version that walks a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_version(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said = (role or "", text or "")
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(said[0])}:{said[0]}{said[1]}".encode()).hexdigest(), said))
    own = {c: [x[3] for x in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        said = own.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:h] + own[c][h:]
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
        ends[tuple(said)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(repr((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())) for p, m in members.items())


def nodes(spark, rows, local=pt.LOCAL, parts=3):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(repr(tuple(r)) for r in pt.conversation_trie(frame, local).collect())


def made(seed, conversations, words=3):
    rng, rows = random.Random(seed), []
    for c in range(conversations):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]) if words > 3 else "user", rng.choice(["é", "ab", "", None, "long text"][:words])))
    return rows


@pytest.mark.parametrize("seed, conversations, local", [(1, 250, 128), (2, 250, 2), (3, 40, 1)])
def test_against_a_plain_version(spark, seed, conversations, local):
    rows = made(seed, conversations, 3 if seed % 2 else 5)
    assert nodes(spark, rows, local) == plain_version(rows)


def test_many_copies_are_packed_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 7)
    rows = [(100 * c, 0, "user", "same") for c in range(300)] + [(100 * c, 1, "user", "same") for c in range(200)] + made(4, 30)
    assert nodes(spark, rows, 2) == plain_version(rows)


def test_long_shared_beginnings_take_one_round(spark):
    rows = [(100 * c + 1, t, "u", "x" if t < 60 else f"{c % 7}{t}" if t < 62 else str(c)) for c in range(40) for t in range(64)]
    assert nodes(spark, rows, 3) == plain_version(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "u", "nobody"), (-5, None, None, None), (-5, None, "a", "b"), (-5, 2, "x", "y"), (-5, 2, "x", "y"), (7, 1, "", "q"), (7, 1, None, "q"), (0, 3, "u", "z" * 100_000), (100, 1, "1:", "a"), (101, 1, "1", ":a"), (299, 0, "u", "v")]
    assert nodes(spark, rows) == plain_version(rows)
    assert nodes(spark, [], parts=1) == []


def test_turns_that_repeat_are_repeated_turns(spark):
    rows = [(400, 1, "u", "a")] * 5 + [(800, 1, "u", "a")] * 3
    assert nodes(spark, rows) == plain_version(rows)


def test_a_turnless_conversation_is_a_member_of_the_root(spark):
    # Conversations that lose all their own turns and have nothing to take them from.
    c = next(c for c in range(1001, 1100) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 0, "u", "a"), (2000, 0, "u", "a")]
    got = nodes(spark, rows)
    assert got == plain_version(rows) and len(got) == 2


def test_multikey_quicksort():
    rng = random.Random(5)
    rows = [list(x) for x in {tuple(rng.randrange(3) for _ in range(rng.randint(0, 6))) for _ in range(300)}]
    order, found = pt.multikey_quicksort(rows, 0)
    assert [rows[i] for i in order] == sorted(rows)
    want = {tuple(r[:d]) for r in rows for d in range(1, len(r) + 1)}
    assert {tuple(rows[order[a]][:d]) for a, _, d in found} == want and len(found) == len(want)
    for a, b, d in found:
        assert sum(r[:d] == rows[order[a]][:d] for r in rows) == b - a
