"""Quality scores: random-indexing word vectors, pooled per document, and a two-layer numpy network with calibrated probabilities.

Tokens are a document's words (letters in lower case, other characters dropped) and, after each, the word's shape: runs of
capitals, small letters, digits and other characters, so case and junk marks are words of their own to the model.
Each token has a sparse random index vector, derived from a hash.  A token's word vector adds up the index vectors of its
neighbours in the training sample (random indexing); tokens not seen there have their index vector.  A document is pooled
into the mean of its vectors, the length of that mean, the share of distinct words and the logarithm of its length.
Words are those between Unicode white space.  The network has one hidden layer; its temperature is fitted on a fifth of the sample that the weights never see.

Fitted on a bounded sample, in one task: of the different labelled texts the ``SAMPLE_ROWS`` of the lowest hash of id and text, as far as they have
``SAMPLE_BYTES`` together.  A row that repeats id and text counts once.  Labels are the only thing taken from elsewhere; language, source and id are never
inputs of a score.

Null and empty texts get the score of a document without tokens.  Rows without labels, ties and repeated rows are scored
like any other; an id with several labels trains on the smallest.  Without any usable label every score is 0.5.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, staged, text_key

#: Labelled rows that the classifier is fitted on at most.
SAMPLE_ROWS = 4_000
#: Bytes of all sample texts at most.
SAMPLE_BYTES = 32 << 20
DIM = 48
WINDOW = 2
NONZERO = 4
VOCABULARY = 60_000
HIDDEN = 24
_LETTERS = re.compile(r"[^\W\d_]+")
_SHAPES = re.compile(r"([A-ZÀ-ÖØ-Þ]+)|([^\W\d_]+)|(\d+)|(\w|[^\w\s])\4*")
_CACHE = 200_000


def _shape(word: str) -> str:
    return "".join("X" if m[1] else "x" if m[2] else "0" if m[3] else m[0][:3] for m in _SHAPES.finditer(word))[:24]


_CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
_MARKS = frozenset(".,;:!?")


def _tokens(word: str) -> tuple[str, str]:
    """A word's letters in lower case, and its shape; the common shapes without a pattern."""
    body, mark = (word[:-1], word[-1]) if word[-1:] in _MARKS else (word, "")
    if body.isalpha():
        if body.islower():
            return body, f"\0x{mark}"
        if body[0] in _CAPITALS and body[1:].islower():
            return body.lower(), f"\0Xx{mark}"
    return "".join(_LETTERS.findall(word)).lower(), f"\0{_shape(word)}"


def index_vectors(tokens: list[str]) -> np.ndarray:
    """Sparse, ternary and of unit length, each from its token's hash alone."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in tokens), np.uint64, len(tokens))
    out = np.zeros((len(tokens), DIM), np.float32)
    rows = np.arange(len(tokens))
    for k in range(NONZERO):
        place = (hashes >> np.uint64(12 * k) & np.uint64(4095)) % np.uint64(DIM)
        out[rows, place.astype(np.int64)] += np.where(hashes >> np.uint64(63 - k) & np.uint64(1), 1.0, -1.0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


@dataclass
class QualityModel:
    known: dict[str, int] = field(default_factory=dict)  # token -> row of vectors
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM), np.float32))
    layers: tuple[np.ndarray, ...] | None = None
    temperature: float = 1.0
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None

    def __post_init__(self):
        self._rows: dict[str, int] = {}
        self._matrix = np.empty((0, DIM), np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def _token_vectors(self, tokens: list[str]) -> np.ndarray:
        rows = np.fromiter((self.known.get(t, -1) for t in tokens), np.int64, len(tokens))
        out = np.empty((len(tokens), DIM), np.float32)
        out[rows >= 0] = self.vectors[rows[rows >= 0]]
        new = np.flatnonzero(rows < 0)
        out[new] = index_vectors([tokens[i] for i in new])
        return out

    def _word_vectors(self, words: list[str]) -> np.ndarray:
        """Each different word's vector, the mean of its tokens'; up to ``_CACHE`` words are remembered."""
        rows = np.fromiter((self._rows.get(w, -1) for w in words), np.int64, len(words))
        out = np.empty((len(words), DIM), np.float32)
        out[rows >= 0] = self._matrix[rows[rows >= 0]]
        lost = np.flatnonzero(rows < 0)
        if len(lost):
            new = [words[i] for i in lost]
            cores, shapes = zip(*map(_tokens, new))
            found = (self._token_vectors(list(cores)) + self._token_vectors(list(shapes))) / 2
            out[lost] = found
            if len(self._rows) + len(new) > _CACHE:
                self._rows, self._matrix = {}, np.empty((0, DIM), np.float32)
            kept = new[:_CACHE]
            start = len(self._rows)
            if start + len(kept) > len(self._matrix):
                grown = np.empty((min(_CACHE, max(2 * start, start + len(kept))), DIM), np.float32)
                grown[:start] = self._matrix[:start]
                self._matrix = grown
            self._matrix[start : start + len(kept)] = found[: len(kept)]
            self._rows.update(zip(kept, range(start, start + len(kept))))
        return out

    def pool(self, texts: pa.Array) -> np.ndarray:
        """A row for each text.  Arrow numbers the different words of all texts, so each is looked up once."""
        n = len(texts)
        out = np.zeros((n, DIM + 3), np.float32)
        cut = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        words = pc.list_flatten(cut).dictionary_encode()
        if not len(words):
            return out
        different = words.dictionary.to_pylist()
        sizes = pc.list_value_length(cut).to_numpy()
        pairs, counts = np.unique(np.repeat(np.arange(n), sizes) * len(different) + words.indices.to_numpy(), return_counts=True)
        doc, word = pairs // len(different), pairs % len(different)
        if "" in different:
            keep = word != different.index("")
            doc, word, counts = doc[keep], word[keep], counts[keep]
        if not len(doc):
            return out
        vectors = self._word_vectors(different)
        total = np.bincount(doc, counts, n)
        for at in range(0, len(doc), 100_000):
            part = slice(at, at + 100_000)
            starts = np.flatnonzero(np.diff(doc[part], prepend=-1))
            out[doc[part][starts], :DIM] += np.add.reduceat(vectors[word[part]] * counts[part, None].astype(np.float32), starts)
        some = total > 0
        out[some, :DIM] /= total[some, None]
        out[some, DIM] = np.linalg.norm(out[some, :DIM], axis=1)
        out[some, DIM + 1] = np.bincount(doc, minlength=n)[some] / total[some] ** 0.9
        out[some, DIM + 2] = np.log1p(total[some])
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(((pooled - self.shift) / self.scale) @ w1 + b1, 0) @ w2 + b2

    def score(self, texts: pa.Array | list[str | None]) -> np.ndarray:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if self.layers is None or not len(texts):
            return np.full(len(texts), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pool(texts)) / self.temperature, -40, 40)))


def fit(texts: list[str], labels: list[int], seed: int = 7) -> QualityModel:
    """Word vectors, network and temperature from labelled texts, in the given order."""
    model = QualityModel()
    if len(set(labels)) < 2:
        return model
    number: dict[str, int] = {}
    tokens_of: dict[str, tuple[int, int]] = {}
    sequences = []
    for text in texts:
        words = text.split()
        for word in words:
            if word not in tokens_of:
                tokens_of[word] = tuple(number.setdefault(t, len(number)) for t in _tokens(word))
        sequences.append(np.array([tokens_of[w] for w in words], np.int32).reshape(-1))
    del tokens_of
    counts = np.bincount(np.concatenate(sequences), minlength=len(number))
    most = sorted(number.items(), key=lambda x: (-counts[x[1]], x[0]))[:VOCABULARY]
    place = np.full(len(number) + 1, -1)
    place[[i for _, i in most]] = np.arange(len(most))
    known = {t: k for k, (t, _) in enumerate(most)}
    del number, most
    index = index_vectors(list(known))
    context = np.zeros_like(index)
    while sequences:
        ids = place[sequences.pop()]
        for step in range(1, WINDOW + 1):
            a, b = ids[:-step], ids[step:]
            both = (a >= 0) & (b >= 0)
            np.add.at(context, a[both], index[b[both]])
            np.add.at(context, b[both], index[a[both]])
    norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-6)
    model.known, model.vectors = known, norm(norm(context) + 0.7 * index).astype(np.float32)

    rng = np.random.default_rng(seed)
    x, y = np.concatenate([model.pool(pa.array(texts[k : k + 500], pa.string())) for k in range(0, len(texts), 500)]), np.array(labels, np.float64)
    apart = np.arange(len(y)) % 5 == 4
    # The share of distinct words weighs more than one of the vector's many dimensions.
    emphasis = np.array([1.0] * DIM + [1.0, 4.0, 1.0])
    model.shift, model.scale = x[~apart].mean(0), (x[~apart].std(0) + 1e-3) / emphasis
    z = (x - model.shift) / model.scale
    p = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    train = np.flatnonzero(~apart)
    for epoch in range(60):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            a, want = z[part], y[part]
            h = np.maximum(a @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - want) / len(part)
            dh = np.outer(d, p[2]) * (h > 0)
            grads, t, rate = [a.T @ dh + 1e-3 * p[0], dh.sum(0), h.T @ d + 1e-3 * p[2], d.sum()], t + 1, 0.01 * (1 - epoch / 60)
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model.layers = tuple(np.asarray(q) for q in p)
    if apart.any():
        out, ones = model.logits(x[apart]), y[apart].sum()
        # Platt's targets: even a perfect fifth doesn't ask for certainty.
        want = np.where(y[apart] > 0, (ones + 1) / (ones + 2), 1 / (len(out) - ones + 2))
        loss = lambda temp: np.mean(np.logaddexp(0, out / temp) - want * out / temp)
        model.temperature = float(min(np.geomspace(0.05, 20, 120), key=loss))
    model.__post_init__()  # forgets the words of the sample
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, trainable: Column | None = None, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Fit on a sample of the labelled documents for which ``trainable`` holds, in one task; only the model reaches the driver."""
    bounded_batches(docs.sparkSession)
    marks = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("__quality"))
    slim = (docs.where(trainable) if trainable is not None else docs).select(
        F.col(doc_id).alias("__id"), text_key(text).alias("__key"), F.coalesce(F.octet_length(text), F.lit(0)).alias("__bytes"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    texts = slim.groupBy("__id", "__key").agg(F.min("__bytes").alias("__bytes")).where(F.col("__bytes") <= sample_bytes)
    first = texts.join(marks, "__id").withColumn("__order", F.xxhash64("__id", "__key")).orderBy("__order", "__id", "__key").limit(sample_rows)
    # At most sample_rows rows are left here.
    so_far = F.sum("__bytes").over(Window.orderBy("__order", "__id", "__key").rowsBetween(Window.unboundedPreceding, 0))
    chosen = staged(first.withColumn("__so_far", so_far).where(F.col("__so_far") <= sample_bytes).select("__id", "__key", "__order", "__quality"), "quality-sample")
    rows = slim.join(F.broadcast(chosen), ["__id", "__key"]).select("__order", "__id", "__key", "__text", "__quality").dropDuplicates(["__id", "__key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marked = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            marked += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, [int(x) for x in marked]))], pa.binary())], ["model"])

    ordered = rows.repartition(1).sortWithinPartitions("__order", "__id", "__key").select("__text", "__quality")
    found = ordered.mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else QualityModel()  # no task has run where there is no row


def scores(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, score double")


def keep_quality(docs: DataFrame, model: QualityModel, text: str = "text", at_least: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``at_least``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score(batch.column(at))
            yield batch.filter(pa.array(found >= at_least))

    return docs.mapInArrow(run, docs.schema)
