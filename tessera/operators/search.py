"""Similarity search: exact by default, pruned by centroids on request."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine
from ..sources.scratch import scratch_path

#: Query vectors that one pass over the embeddings holds.
QUERY_BLOCK = 1024
#: Embeddings that a task compares with a block of queries at once; a block and so many make 8 MB of similarities.
TILE_ROWS = 1024
#: Embeddings that a round of a search for documents takes at most.
ROUND_ROWS = 65_536
#: Ids that are pushed into a scan at most; a larger page is joined alone.
PUSHED_IDS = 1000


def literal_vector(vector: Sequence[float]):
    return F.array(*[F.lit(float(x)) for x in vector])


def scored(embeddings: DataFrame, vector: Sequence[float], column: str = "embedding") -> DataFrame:
    return embeddings.withColumn("similarity", cosine(F.col(column), literal_vector(vector)))


def top(rows: DataFrame, count: int, offset: int = 0, key: str = "document_id") -> DataFrame:
    """Rows ranked ``offset + 1`` to ``offset + count`` by falling similarity, ties by id; a count of 0 gives none.

    Spark plans this as TakeOrderedAndProject: each task keeps its best and the driver merges them.
    """
    if count < 0 or offset < 0:
        raise ValueError("count and offset must not be negative")
    # Nulls come last and go after the limit: tested before it, every similarity would be computed twice.
    return rows.orderBy(F.desc_nulls_last("similarity"), key).offset(offset).limit(count).where("similarity IS NOT NULL")


def search(embeddings: DataFrame, vector: Sequence[float], count: int = 20, offset: int = 0, key: str = "document_id") -> DataFrame:
    """The nearest embeddings, all of them compared."""
    return top(scored(embeddings, vector).select(key, "similarity"), count, offset, key)


def best_by_document(similarities: DataFrame, document_id: str = "document_id") -> DataFrame:
    """A document's similarity is that of its nearest embedding."""
    return similarities.groupBy(document_id).agg(F.max("similarity").alias("similarity"))


def search_documents(embeddings: DataFrame, vector: Sequence[float], count: int = 20, offset: int = 0) -> DataFrame:
    """The nearest documents, each by the nearest of its embeddings; all are compared, and nothing is shuffled.

    The best embeddings are taken, and documents that have been found are left out of the next round, until there are enough: what stands first
    among embeddings is in the order of documents.  A round takes twice the rows of the one before, up to ``ROUND_ROWS``, so documents of
    very many embeddings cost few rounds.
    """
    if count < 0 or offset < 0:
        raise ValueError("count and offset must not be negative")
    key = embeddings.schema["document_id"].dataType.simpleString()
    rows = scored(embeddings, vector).select("document_id", "similarity")
    best: dict = {}
    need = (offset + count) if count else 0
    take = need + 8
    while len(best) < need:
        left = rows.where(~F.col("document_id").isin(list(best))) if best else rows
        found = top(left, take).collect()
        for r in found:
            best.setdefault(r["document_id"], r["similarity"])
        if len(found) < take:
            break
        take = min(2 * take, max(ROUND_ROWS, need + 8))
    page = list(best.items())[offset:need]
    return embeddings.sparkSession.createDataFrame(page, f"document_id {key}, similarity double")


def with_documents(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Search results in the service's columns.

    ``found`` holds a page of results, so its size is bounded by the count.  Its ids come to the driver and are pushed down into the
    scan of ``documents``, which then skips whatever its statistics exclude.
    """
    page = [(r["document_id"], r["similarity"]) for r in found.collect()]
    local = documents.sparkSession.createDataFrame(page, "document_id long, similarity double")
    wanted = documents.where(F.col("document_id").isin([i for i, _ in page])) if len(page) <= PUSHED_IDS else documents
    return wanted.join(F.broadcast(local), "document_id").select(
        "name", "external_id", "document", "document_id", F.col("similarity").alias("document_similarity"))


def search_batch(embeddings: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", query_key: str = "query_id", column: str = "embedding", probes: tuple[list, Callable[[list, np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """(query_id, key, similarity, rank) of the k nearest of every query.

    Queries go out in blocks of ``QUERY_BLOCK`` vectors, whatever their number; all blocks but the last write their results to
    the shared folder before the next goes out.  A task multiplies ``TILE_ROWS`` embeddings at once by the block and
    keeps k rows a query, so its memory doesn't grow with either table, and what is shuffled is k rows a query and task.

    ``probes``: ids of centroids, and a function from a block's query ids and unit vectors to marks, a row a query and a column a centroid; embeddings then
    have a ``centroid_id``, a query is multiplied with those of its centroids alone, and embeddings that no query of the block marks aren't read.
    """
    spark = embeddings.sparkSession

    def one(block: list) -> DataFrame:
        ids = [r[0] for r in block]
        matrix = np.array([r[1] for r in block], np.float64)
        unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        asks: dict[int, np.ndarray] = {}  # centroid -> the queries that probe it
        if probes:
            names, chosen = probes
            marks = chosen(ids, unit)
            asks = {names[c]: np.flatnonzero(marks[:, c]) for c in np.flatnonzero(marks.any(0)).tolist()}
        shared = spark.sparkContext.broadcast((ids, unit, asks))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, unit, asks = shared.value
            # The best so far, by place of the query, then by falling similarity and key.
            of, sim, found = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
            worst = np.full(len(ids), -np.inf)  # what a row must reach to be among a query's k
            for batch in batches:
                for at in range(0, batch.num_rows, TILE_ROWS):
                    part = batch.slice(at, TILE_ROWS)
                    keys = part.column(0).to_numpy(zero_copy_only=False)
                    rows = np.array(part.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(keys), -1)
                    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
                    if probes:
                        got, cell = np.full((len(ids), len(keys)), -np.inf), np.array(part.column(2).to_pylist(), object)
                        for c in set(cell.tolist()):
                            q, r = asks.get(c, ()), np.flatnonzero(cell == c)
                            if len(q):
                                got[np.ix_(q, r)] = unit[q] @ rows[r].T
                    else:
                        got = unit @ rows.T
                    least = np.maximum(worst, np.partition(got, len(keys) - k, axis=1)[:, len(keys) - k]) if 0 < k < len(keys) else worst
                    q, r = np.nonzero((got >= least[:, None]) & np.isfinite(got))
                    if not len(q):
                        continue
                    of, sim, found = np.concatenate([of, q]), np.concatenate([sim, got[q, r]]), np.concatenate([found, keys[r]])
                    order = np.lexsort((found, -sim, of))
                    starts = np.searchsorted(of[order], np.arange(len(ids)))
                    order = order[np.arange(len(order)) - starts[of[order]] < k]
                    of, sim, found = of[order], sim[order], found[order]
                    last = np.searchsorted(of, np.arange(len(ids))) + k - 1
                    full = np.bincount(of, minlength=len(ids)) >= max(k, 1)
                    worst[full] = sim[last[full]]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[of]), pa.array(found, pa.int64()), pa.array(sim, pa.float64())], [query_key, key, "similarity"])

        rows = embeddings.where(F.col(column).isNotNull())
        if probes and len(asks) <= PUSHED_IDS:
            named = [c for c in asks if c is not None]
            wanted = F.col("centroid_id").isin(named) if named else F.lit(False)
            rows = rows.where(wanted | F.col("centroid_id").isNull() if None in asks else wanted)
        slim = rows.select(F.col(key).cast("long").alias(key), column, *(["centroid_id"] if probes else []))
        return slim.mapInArrow(run, f"{query_key} long, {key} long, similarity double")

    def ranked(found: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("similarity"), key))
        return found.withColumn("rank", place.cast("long")).where(F.col("rank") <= k)

    path, block = None, []
    for row in queries.where(F.col(column).isNotNull()).select(F.col(query_key).cast("long"), column).toLocalIterator():
        if len(block) == QUERY_BLOCK:
            path = path or scratch_path(spark, "search")
            ranked(one(block)).write.mode("append").parquet(path)
            block = []
        block.append(row)
    if not block:
        return ranked(embeddings.limit(0).select(F.lit(0).cast("long").alias(query_key), F.col(key).cast("long").alias(key), F.lit(0.0).alias("similarity")))
    last = ranked(one(block))
    return spark.read.schema(last.schema).parquet(path).unionByName(last) if path else last
