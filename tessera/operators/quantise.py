"""Product quantisation: a byte for each part of a vector, and exact re-ranking of a shortlist.

A unit vector is cut into parts; each part is replaced by the nearest entry of its codebook.  A query makes a table of the products of its parts with all entries, so
the similarity of a code is a sum of table entries.  The best ``shortlist`` codes of a query are then compared by their vectors.

Codebooks are fitted on a sample of at most ``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES``, drawn by hash, one part a task; every row is coded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine
from ..sources.scratch import scratch_path
from .search import QUERY_BLOCK

SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 32 << 20
ENTRIES = 256
ROUNDS = 12
#: Codes of each query that are compared by their vectors, for each row asked for.
SHORTLIST = 15
_ROWS = 2048


def _units(column: pa.Array, rows: int) -> np.ndarray:
    flat = np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(rows, -1)
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-300)


def lloyd(rows: np.ndarray, entries: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """``entries`` centres of rows; fewer different rows give fewer."""
    different = np.unique(rows, axis=0)
    rng = np.random.default_rng(seed)
    centres = different[rng.permutation(len(different))[:entries]]
    for _ in range(rounds if len(different) > entries else 0):
        near = np.concatenate([_nearest(rows[a : a + 4096], centres) for a in range(0, len(rows), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        n = np.bincount(near, minlength=len(centres))
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)


def fit_codebooks(embeddings: DataFrame, parts: int = 16, entries: int = ENTRIES, seed: int = 1, key: str = "vec_id", column: str = "embedding") -> list[np.ndarray]:
    """The codebook of each part, fitted side by side."""
    spark = embeddings.sparkSession
    usable = embeddings.where(F.col(column).isNotNull())
    first = usable.select(F.size(column).alias("d")).first()
    if first is None:
        return []
    rows = min(SAMPLE_ROWS, max(entries, SAMPLE_BYTES // (4 * first["d"])))
    sample = usable.select(F.xxhash64(F.lit(seed), key).alias("h"), column).orderBy("h", column).limit(rows).toArrow()
    shared = spark.sparkContext.broadcast(_units(sample[column].combine_chunks(), len(sample)).astype(np.float32))
    ends = np.linspace(0, first["d"], parts + 1).astype(int).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                book = lloyd(shared.value[:, ends[part] : ends[part + 1]].astype(np.float64), entries, seed + part)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([book.shape[1]], pa.int32()), pa.array([book.tobytes()], pa.binary())], ["part", "dim", "book"])

    found = spark.range(parts, numPartitions=parts).mapInArrow(run, "part int, dim int, book binary").collect()
    return [np.frombuffer(r["book"], np.float64).reshape(-1, r["dim"]) for r in sorted(found, key=lambda r: r["part"])]


def quantised(embeddings: DataFrame, codebooks: list[np.ndarray], key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, code) of every embedding: one byte a part."""
    shared = embeddings.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        ends = np.cumsum([0, *(b.shape[1] for b in books)])
        for batch in batches:
            rows = _units(batch.column(1), batch.num_rows) if batch.num_rows else np.zeros((0, ends[-1]))
            codes = np.stack([_nearest(rows[:, a:b], book) for book, a, b in zip(books, ends, ends[1:])], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], [key, "code"])

    slim = embeddings.where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias(key), column)
    return slim.mapInArrow(run, f"{key} long, code binary")


def quantised_batch(codes: DataFrame, embeddings: DataFrame, codebooks: list[np.ndarray], queries: DataFrame, k: int = 20, shortlist: int | None = None, key: str = "vec_id", query_key: str = "query_id", column: str = "embedding") -> DataFrame:
    """(query_id, key, similarity, rank) of the k nearest of each query among its shortlist.

    A task keeps the best codes of each query; what is shuffled, and joined with the vectors, is the shortlists.
    """
    spark = codes.sparkSession
    most = shortlist or SHORTLIST * k

    def one(block: list) -> DataFrame:
        ids = [r[0] for r in block]
        units = np.array([r[1] for r in block], np.float64)
        units /= np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-300)
        ends = np.cumsum([0, *(b.shape[1] for b in codebooks)])
        shared = spark.sparkContext.broadcast((np.array(ids, np.int64), [(units[:, a:b] @ book.T).astype(np.float32) for book, a, b in zip(codebooks, ends, ends[1:])]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, tables = shared.value
            best, best_key = np.empty((len(ids), 0), np.float32), np.empty((len(ids), 0), np.int64)
            for batch in batches:
                for a in range(0, batch.num_rows, _ROWS):
                    some = batch.slice(a, _ROWS)
                    raw = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(some.num_rows, -1)
                    got = sum(table[:, raw[:, m]] for m, table in enumerate(tables))
                    best = np.hstack([best, got])
                    best_key = np.hstack([best_key, np.broadcast_to(some.column(0).to_numpy(), got.shape)])
                    order = np.lexsort((best_key, -best), axis=1)[:, :most]
                    best, best_key = np.take_along_axis(best, order, 1), np.take_along_axis(best_key, order, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(best_key.reshape(-1)), pa.array(best.reshape(-1).astype(np.float64))], [query_key, key, "about"])

        return codes.select(key, "code").mapInArrow(run, f"{query_key} long, {key} long, about double")

    path, block = scratch_path(spark, "shortlists"), []
    spark.createDataFrame([], f"{query_key} long, {key} long").write.parquet(path)

    def flush() -> None:
        place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("about"), key))
        one(block).withColumn("place", place).where(F.col("place") <= most).select(query_key, key).write.mode("append").parquet(path)
        block.clear()

    for row in queries.where(F.col(column).isNotNull()).select(F.col(query_key).cast("long"), column).toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            flush()
    if block:
        flush()
    pairs = spark.read.schema(f"{query_key} long, {key} long").parquet(path)
    asked = queries.select(F.col(query_key).cast("long").alias(query_key), F.col(column).alias("__asked"))
    near = pairs.join(embeddings.select(F.col(key).cast("long").alias(key), column), key).join(asked, query_key).select(query_key, key, cosine(F.col(column), F.col("__asked")).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("similarity"), key))
    return near.where("similarity IS NOT NULL").withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
