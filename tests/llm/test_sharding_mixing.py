"""Sharding and mixing against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, `group` string, `key` string, size int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", 1) for i, t, s in rows], SCHEMA)


ODD = [(1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "w " * 30_000, "b"), (5, "same text", "a"), (5, "same text", "a"), (6, "same text", None), (None, "no id", "b"), (7, "é ß 日本", "c")]


def checked_shards(rows, n):
    slots = defaultdict(list)
    of_text = {}
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        of_text.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    assert set(slots) <= set(range(n))


def test_lpt_schedules_by_falling_size():
    rng = random.Random(1)
    items = [(str(i), rng.randint(1, 1000)) for i in range(500)]
    placed = sharding.lpt(items, 7)
    loads = [0] * 7
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        assert placed[key] == min(range(7), key=lambda s: (loads[s], s))
        loads[placed[key]] += size
    assert max(loads) - min(loads) <= 1000
    assert sharding.lpt([], 3) == {}


def test_shards_are_even_and_keep_copies(spark):
    rng = random.Random(2)
    rows = [(i, "t" * rng.randint(0, 300) + str(rng.randint(0, 400)), "s") for i in range(3000)]
    got = sharding.assign_shards(frame(spark, rows), 8).collect()
    assert len(got) == 3000
    checked_shards(got, 8)
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) < 1.02 * min(loads.values())
    texts = dict((i, t) for i, t, _ in rows)
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)


def test_many_items_of_a_size_go_as_the_heap_would_send_them():
    rng = random.Random(6)
    for n_shards in (1, 3, 24):
        items = [(str(i), float(rng.randint(1, 60)), rng.choice((1, 2, 40, 700))) for i in range(40)]
        loads = [0.0] * n_shards
        placed = sharding.lpt_many(items, n_shards)
        for key, size, n in sorted(items, key=lambda x: (-x[1], x[0])):
            counts = [0] * n_shards
            for _ in range(n):
                s = min(range(n_shards), key=lambda s: (loads[s], s))
                loads[s] += size
                counts[s] += 1
            # Equal loads may trade places; the loads that follow are the same.
            assert sorted(load - c * size for load, c in zip(loads, counts)) and sum(placed[key]) == n
        got = [sum(size * placed[key][s] for key, size, _ in items) for s in range(n_shards)]
        assert sorted(got) == pytest.approx(sorted(loads), abs=60)
        assert max(got) - min(got) <= 60


@pytest.mark.parametrize("fineness", [256, 1])
def test_loads_are_those_of_a_schedule_of_all_groups(spark, fineness):
    """With every group an item, and with nearly all in classes of sizes."""
    rng = random.Random(3)
    rows = [(i, f"{rng.randint(0, 900)} " + "t" * int(rng.paretovariate(1.1) * 20), "s") for i in range(3000)]
    got = sharding.assign_shards(frame(spark, rows), 6, fineness=fineness).collect()
    checked_shards(got, 6)
    sizes = Counter()
    for _, t, _ in rows:
        sizes[t] += len(t) + 8
    placed, plain = sharding.lpt(sizes.items(), 6), Counter()
    for t, s in placed.items():
        plain[s] += sizes[t]
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) <= max(plain.values()) + (0 if fineness > 1 else 0.01 * sum(sizes.values()) / 6)


def test_a_group_of_a_third_of_all_rows_stays_whole(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i}", "s") for i in range(900)]
    checked_shards(got := sharding.assign_shards(frame(spark, rows), 4).collect(), 4)
    assert len(got) == 900


def test_shards_of_odd_rows(spark):
    got = sharding.assign_shards(frame(spark, ODD), 3).collect()
    assert len(got) == len(ODD)
    checked_shards(got, 3)
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (1, 2)} == {(8, 0)}
    assert sharding.assign_shards(frame(spark, ODD).limit(0), 3).count() == 0


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, full = 1.5 * sum(sizes.values()), dict.fromkeys(sizes, 0.0), set()
    while True:
        open_ = [s for s in order if s not in full]
        if not open_:
            return target
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if 2 * sizes[s] <= level * weight[s]]
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            full.add(s)
        if not over:
            return target | {s: level * weight[s] for s in open_}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_its_targets(spark, seed):
    rng = random.Random(seed)
    names = [None, "a", "B", "é", "c", "d"]
    share = [rng.random() ** 3 + 0.01 for _ in names]
    rows = [(i, "w " * rng.randint(0, 40), rng.choices(names, share)[0]) for i in range(1500)]
    got = mixing.mix(frame(spark, rows)).collect()
    again = mixing.mix(frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {i: s for i, _, s in rows}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[source[r["doc_id"]]] += r["size"]
    expected = plain_targets(dict(sizes))
    for r in got:
        s = source[r["doc_id"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[s]
        taken[s] += r["taken"]
        target[s] = r["target"]
    for s in sizes:
        assert target[s] == pytest.approx(expected[s], rel=1e-9)
        assert taken[s] == int(target[s])


def test_a_source_s_mix_follows_its_keys(spark):
    """The last epoch of a source is a prefix of its documents by key, cut at a word."""
    rows = [(i, "w " * (i % 13), "hot" if i % 3 else "b") for i in range(600)]
    source, text = {i: s for i, _, s in rows}, {i: t for i, t, _ in rows}
    got = mixing.mix(frame(spark, rows)).collect()
    for name in ("hot", "b"):
        own = sorted((hashlib.md5(f"{r['doc_id']}:mix:{hashlib.md5(text[r['doc_id']].encode()).hexdigest()}".encode()).hexdigest(), r["taken"] - int(r["target"]) // r["source_size"] * r["size"], r["size"]) for r in got if source[r["doc_id"]] == name)
        left = int(own and next(int(r["target"]) % r["source_size"] for r in got if source[r["doc_id"]] == name))
        for _, part, size in own:
            assert part == min(size, left)
            left -= part


def test_mix_of_odd_rows(spark):
    got = mixing.mix(frame(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert {r["size"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mix(frame(spark, ODD).limit(0)).count() == 0
    nothing = mixing.mix(frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r["taken"], r["target"]) for r in nothing] == [(0, 0.0)] * 2


def test_mixed_rows_repeat_whole_documents(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(1, 9) + str(i), rng.choice(["a", "b", "c", None])) for i in range(800)]
    docs = frame(spark, rows)
    planned = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    times = Counter(r["doc_id"] for r in got.collect())
    words, goal = Counter(), {}
    for i, t, s in rows:
        words[s] += times[i] * planned[i]["size"]
        goal[s] = planned[i]["target"]
        whole, part = divmod(planned[i]["taken"], planned[i]["size"])
        assert times[i] == whole + (2 * part >= planned[i]["size"] and part > 0)
    for s in goal:
        assert abs(words[s] - goal[s]) <= 11


def test_word_counts(spark):
    texts = ["a b", " a\x0b b\r\n", "a b", None, "", "日本 x", "a\x1cb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t")).alias("n"))
    assert [r["n"] for r in rows.collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


@pytest.mark.parametrize("ids", ["none", "one", "some"])
def test_mixed_rows_without_ids_meet_their_targets(spark, ids):
    """Rows whose ids are null or repeated come or go one by one, equal ones too."""
    rng = random.Random(7)
    texts = [f"{'w ' * rng.randint(0, 9)}t{i}" for i in range(150)] + ["same text of five words"] * 120 + [None, ""] * 3
    rows = [(None if ids == "none" else 7 if ids == "one" else i % 3, t, "abc"[i % 3]) for i, t in enumerate(texts)]
    docs = frame(spark, rows).repartition(5)
    sizes = [len((t or "").split()) for t in texts]
    for weights in ((5, 2, 1), (1, 5, 2), (1, 1, 9)):
        words, target = Counter(), plain_targets_of(rows, sizes, weights)
        for r in mixing.mixed_rows(docs, weights=weights).collect():
            words[r["source"]] += len((r["text"] or "").split())
        for s in "abc":
            assert abs(words[s] - target[s]) <= max(sizes), (weights, s, words, target)
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["source_size"], int(r["target"])] += r["taken"]
    assert all(sum(n for (a, b), n in taken.items() if (a, b) == k) % k[1] == 0 for k in taken)


def plain_targets_of(rows, sizes, weights):
    of = Counter()
    for (_, _, s), n in zip(rows, sizes):
        of[s] += n
    target, left, open_ = {}, 1.5 * sum(of.values()), sorted(of)
    weight = dict(zip(sorted(of), weights))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if 2 * of[s] <= level * weight[s]]
        for s in over:
            target[s] = 2.0 * of[s]
            left -= target[s]
        if not over:
            return target | {s: level * weight[s] for s in open_}
        open_ = [s for s in open_ if s not in over]
    return target


def test_copies_in_bulk_are_dealt_in_lots(spark, monkeypatch):
    from tessera.llm import _common

    monkeypatch.setattr(_common, "LOT", 16)
    rows = [(None, None, "a")] * 300 + [(None, "equal", "a")] * 200 + [(i, f"t {i} x", "b") for i in range(100)]
    got = sharding.assign_shards(frame(spark, rows), 4).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r["shard"] for r in got if r["size"] == 8}) == 1
    assert sum(r["taken"] for r in mixing.mix(frame(spark, rows)).collect()) == sum(int(t) for t in {r["source_size"]: r["target"] for r in mixing.mix(frame(spark, rows)).collect()}.values())
