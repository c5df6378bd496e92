"""Token segments: exact round trips against the library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import token_files as tf

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_cached_encoding_is_the_library_s(library):
    rng = random.Random(1)
    alphabet = " \n\t\r aaBs'é1!<|endoftext|>\x1c\x85​  日本 .,;ñ'll're"
    texts = ["", " ", "a", " a", "a ", "\n", "don't we'll", "<|endoftext|>", "x" * 5000] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    encoder = tf.CachedEncoder(PATH, cache=500)
    for size, end in ((len(texts), None), (1, 0), (7, 0), (500, None)):
        for at in range(0, len(texts), size):
            some = texts[at : at + size]
            for text, raw in zip(some, encoder.encode(pa.array(some, pa.string()), end).to_pylist(), strict=True):
                assert np.frombuffer(raw, "<u2").tolist() == library(text) + ([] if end is None else [end]), repr(text)
    assert library("a <|endoftext|> b") == [64, 220, 50256, 275]
    assert encoder.encode(pa.array([None, "a"], pa.string())).to_pylist()[0] == b"" and len(encoder.encode(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("n, u", [(1, 0), (1, 5), (3, 0), (700, 100_000), (5000, 7), (300, 300), (257, 1 << 20)])
def test_elias_fano(n, u):
    ends = np.sort(np.random.default_rng(n).integers(0, u + 1, n))
    ends[-1] = u
    for width in (2, 4):
        raw = tf.pack_segment(np.arange(u) % 50_000, ends, width)
        s = tf.Segment(raw)
        assert s.ends().tolist() == ends.tolist() and [s.select(i) for i in range(n)] == ends.tolist()
        assert s.document(n - 1).tolist() == (np.arange(u) % 50_000)[ends[-2] if n > 1 else 0 :].tolist()
        assert len(raw) <= 64 + width * u + n * (2 + max(0, np.log2(max(1, u / n)))) / 8 + n / 32 + 64
    with pytest.raises(IndexError):
        s.select(n)
    with pytest.raises(ValueError):
        tf.Segment(raw[:-8])
    with pytest.raises(ValueError):
        tf.Segment(b"x" * 64)


def test_write_and_read(spark, library, monkeypatch):
    monkeypatch.setattr(tf, "BUCKET_ROWS", 50)
    rng = random.Random(3)
    texts = [None, "", "   ", "long " * 20_000] + [" ".join("".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    rows = [(7 * i, t, 0, b"") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int, ids binary")
    got = sorted(tuple(r) for r in tf.read_segments(tf.write_segments(docs, PATH, segment_ids=3000)).collect())
    start, expected = 0, []
    for i, t, *_ in sorted(rows):
        ids = [*library(t), 0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    assert tf.read_segments(tf.write_segments(docs.limit(0), PATH)).count() == 0


def test_repeated_and_null_ids(spark, library):
    rows = [(None, "n"), (4, "b"), (4, "b"), (1, "a a")]
    got = tf.read_segments(tf.write_segments(spark.createDataFrame(rows, "doc_id long, text string"), PATH)).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(None, 0, 2), (1, 2, 3), (4, 5, 2), (4, 7, 2)]


def test_other_tokenizers_are_encoded_by_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, plain = tf.CachedEncoder(path), Tokenizer.from_file(path)
    texts = ["It's a Text", "", "x <|endoftext|>y", "A  b\nc"]
    got = encoder.encode(pa.array(texts), 0).to_pylist()
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_an_id_that_holds_most_rows_is_split(spark, library, monkeypatch):
    monkeypatch.setattr(tf, "BUCKET_ROWS", 20)
    rows = [(5, "a b c")] * 300 + [(None, "n n")] * 200 + [(i, f"text {i}") for i in range(100)] + [(6, "z")]
    segments = tf.write_segments(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert max(len(r["doc_ids"]) for r in segments) < 150
    got = tf.read_segments(tf.write_segments(spark.createDataFrame(rows, "doc_id long, text string"), PATH)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
