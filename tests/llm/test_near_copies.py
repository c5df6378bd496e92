"""Near copies by shingle similarity against brute force."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import components, near_copies, simhash

SCHEMA = "doc_id long, text string"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """(id, text) of each component's first row, nulls last."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            if root[i] != root[j] and 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return {rows[r] for r in root}


def edited(n, seed, long=(3, 5, 40, 90, 300)):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            t = rng.choice(out).split(" ")
            for _ in range(rng.choice((0, 1, 1, 2, 3, 6))):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
        else:
            out.append(" ".join(rng.choices(words, k=rng.choice(long))))
    return out


def test_the_stage_finds_edited_copies(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(1, base), (2, base.replace("w50 ", "other ")), (3, base.replace("w20 ", "a ").replace("w60 ", "b ").replace("w80 ", "c "))]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert (simhash.fingerprint(rows[0][1].encode()) ^ simhash.fingerprint(rows[1][1].encode())).bit_count() > 2
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [1, 3]


def test_kept_rows_equal_brute_force(spark, monkeypatch):
    for seed, hubs, chunk_rows, small in ((1, near_copies.HUBS, None, near_copies.SMALL), (2, 1, 4, 3)):
        monkeypatch.setattr(near_copies, "SMALL", small)
        rng = random.Random(seed)
        rows = [(i, t) for i, t in enumerate([*edited(250, seed), "a b", "A  b\n", "x x x x x x x x"])]
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, SCHEMA)
        linked = near_copies.near_copy_roots(docs, hubs=hubs, chunk_rows=chunk_rows)
        groups = linked.unionByName(linked.select(F.col("b").alias("a"), "b").distinct()).toDF("key", "component")
        kept = components.keep_one(docs, groups).collect()
        assert sorted(map(tuple, kept)) == sorted(plain_kept(rows))
        assert 50 < len(kept) < 230


def test_shingle_sets_and_sketches():
    """Sets have the sizes and overlaps of plain sets; sketches follow their definitions."""
    import numpy as np
    import pyarrow as pa

    texts = ["", None, "a", "A b", "a b c d e", "a b c d e f", "\x0b a\tb  c\r\n", "É é x y z w", "x " * 50_000, *edited(60, 4)]
    found, plain = near_copies.shingle_sets(pa.array(texts)), [plain_set(t) for t in texts]
    for i, a in enumerate(plain):
        assert len(found[i]) == len(a)
        for j in range(i):
            assert len(np.intersect1d(found[i], found[j])) == len(a & plain[j])
    for own in found:
        bits = np.unpackbits(np.frombuffer(near_copies.sketch(own), np.uint8))
        for half, hashes in ((bits[:64], own), (bits[64:128], near_copies._mixed(own, 0xFF51AFD7ED558CCD))):
            assert half.tolist() == [int(2 * sum(int(h) >> (8 * (b // 8) + 7 - b % 8) & 1 for h in hashes) > len(own)) for b in range(64)]
        assert bits[near_copies.BITS :].tolist() == [int((own & np.uint64(near_copies.PARITY - 1) == b).sum() % 2) for b in range(near_copies.PARITY)]


def test_the_radius_holds_pairs_of_the_similarity():
    """Of random pairs of sets at a similarity of just 0.8, of many sizes, none is further apart than the radius."""
    import numpy as np

    rng = np.random.default_rng(3)
    worst = 0
    for n in (5, 10, 40, 90, 270, 900):
        for _ in range(300):
            shared, own = rng.integers(0, 1 << 63, (4 * n) // 5 * 2, dtype=np.uint64) * np.uint64(2), rng.integers(0, 1 << 63, n, dtype=np.uint64)
            side = len(shared) // 8
            a, b = np.concatenate([shared, own[:side]]), np.concatenate([shared, own[side : 2 * side]])
            if near_copies.alike(np.unique(a), np.unique(b)):
                x, y = (np.unpackbits(np.frombuffer(near_copies.sketch(s)[: near_copies.BITS // 8], np.uint8)) for s in (a, b))
                worst = max(worst, int((x != y).sum()))
    assert 25 < worst <= near_copies.RADIUS


def test_ids_that_repeat_or_are_missing(spark):
    a, b, c = edited(3, 3, (60,))[0], "one two three four five six", "seven eight"
    rows = [(5, a), (5, b), (3, b), (None, c), (None, "nine ten"), (None, a), (5, a), (7, None), (8, ""), (None, " ")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = near_copies.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(5, a), (3, b), (None, c), (None, "nine ten"), (7, None)]))
    assert near_copies.keep_first(docs.limit(0)).count() == 0


def test_prefixes_lose_no_pair():
    for n in range(1, 200):
        # Of n shingles ceil(0.8 n) are shared at least; one of them is in the prefix wherever they stand.
        assert near_copies.prefix_length(n) + -(-4 * n // 5) == n + 1


def test_a_step_leaves_nothing_in_the_driver(spark, monkeypatch):
    """Every step that is written lets go of what it held before the next one is planned."""
    from tessera.llm import _common, mixing

    done, let_go = _common.staged_count(), []
    monkeypatch.setattr(_common, "release", lambda s, f=_common.release: (f(s), let_go.append(_common.staged_count())))
    docs = spark.createDataFrame([(i, f"a b c d e f g {i % 3}", "en", "s", 15) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    assert near_copies.keep_first(docs).count() == 3
    mixing.mixed_rows(docs).count()
    assert let_go == list(range(done + 1, _common.staged_count() + 1)) and len(let_go) > 8
