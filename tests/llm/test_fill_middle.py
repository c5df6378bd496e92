"""Fill-in-the-middle against a plain version, at chunk sizes that put cuts, characters and sentinels across chunks."""

import hashlib
import random

import pytest

from tessera.llm import fill_middle as fm
from tessera.llm import queries

SENTINELS = ("<P>", "<S>", "<M>")


def plain_version(doc_id, text, plain_share=10, spm_share=20):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= 100 - plain_share:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_share:
        return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def random_texts(count, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", "b ", "<", "P", ">", "é", "日", "😀", "S>", "<P", "\n"]) for _ in range(rng.randint(0, longest))) for _ in range(count)]


def test_scans_of_chunks_compose():
    rng = random.Random(1)
    for text in ["", "a", "<P>", "<<M>", "😀<S", *random_texts(400, 40, 2)]:
        raw, ends = text.encode(), [0]
        for c in text:
            ends.append(ends[-1] + len(c.encode()))
        size, state, hits, got = rng.randint(1, 20), 0, 0, [0]
        for at in range(0, len(raw), size):
            scan = fm.Scan(raw[at : at + size])
            got += [at + scan.end_of(k, state) for k in range(1, int(scan.units[state]) + 1)]
            hits, state = hits + int(scan.hits[state]), int(scan.step[state])
        assert got == ends and hits == sum(text.count(s) for s in SENTINELS)
    with pytest.raises(IndexError):
        fm.Scan(b"ab").end_of(3, 0)


def test_composition_is_associative():
    runs = [tuple(x[None] for x in (s.step, s.units, s.hits)) for s in map(fm.Scan, [b"a<", "😀".encode()[:2], b"\x98\x80<P", b">", b""])]
    left = runs[0]
    for r in runs[1:]:
        left = fm.compose(left, r)
    right = runs[-1]
    for r in reversed(runs[:-1]):
        right = fm.compose(r, right)
    assert all((x == y).all() for x, y in zip(left, right))


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 16])
def test_against_a_plain_version(spark, chunk):
    texts = [None, "", "same", "same", "é" * 700, "<P>" + "x" * 300, "x" * 63 + "<S>", "x" * 62 + "<M>", "ab<", *random_texts(150, 90, 3)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    # Null ids, and rows that repeat an id, a text or both.
    rows += [(None, "né" * 200, "x", 1)] * 3 + [(None, "other" * 100, "x", 1), (None, None, "x", 1), (5, "again" * 50, "x", 1), (4, "é" * 700, "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    got = fm.fill_in_middle(docs, chunk=chunk)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(plain_version(i, t)) for i, t, *_ in rows)
    back = got.select("doc_id", fm.restored(got["form"], got["output"]).alias("text")).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((i, t or "")) for i, t, *_ in rows)


def test_a_very_long_text_and_string_ids(spark):
    rows = [("long", "Zeile é 日本 😀\n" * 60_000), ("short", "ab"), (None, "c" * 70_000)]
    got = fm.fill_in_middle(spark.createDataFrame(rows, "name string, body string"), "name", "body", plain_share=0, spm_share=50)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(plain_version(i, t, 0, 50)) for i, t in rows)


def test_an_empty_table(spark):
    assert fm.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([None, "", *random_texts(300, 200, 6), "w é " * 40_000])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    hexed = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    want = [(*(p := plain_version(i, t))[:5], hexed(p[5]), hexed(t)) for i, t in rows]
    assert sorted(map(repr, map(tuple, queries.op13_fill_in_middle(spark, str(tmp_path)).collect()))) == sorted(map(repr, want))
