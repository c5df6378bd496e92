"""Exact search that reads only the cells that can matter.

A cell is what is assigned to one centroid.  It has a radius: the largest angle between the centroid and a member.  A query at an angle ``t`` of the centroid finds
nothing in the cell above ``cos(max(0, t - radius))``.  Cells are read in falling order of that bound until they hold the rows asked for; after that only
those are read whose bound isn't below the last of the results.  So the results are those of comparing everything, in two passes at most.

How many cells that spares is up to the vectors: most of them where vectors are clustered, hardly any where they are as good as random.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine
from ..schema import CENTROID
from ..sources.commits import Table
from .search import scored, search_batch, search_documents, top

#: What a computed angle can be off by.
MARGIN = 1e-6
#: Rows that the first pass reads for each row asked for.
FIRST_ROWS = 4
_CELL = "centroid_id long, radius double, n long"


def cell_radii(assigned: DataFrame, centroids: DataFrame, column: str = "embedding") -> DataFrame:
    """(centroid_id, radius, n) of every cell, in one pass; what has no centroid is a cell of radius pi, and what has no similarity counts to no radius."""
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col(column), F.col("centroid")))))
    rows = assigned.select("centroid_id", column).join(F.broadcast(centroids), "centroid_id", "left")
    return rows.groupBy("centroid_id").agg(F.when(F.col("centroid_id").isNull(), F.lit(math.pi)).otherwise(F.coalesce(F.max(angle), F.lit(0.0))).alias("radius"), F.count(F.lit(1)).alias("n"))


@dataclass
class Cells:
    """The cells of a table: ids, unit centroids, radii and rows; ids of None are rows without a centroid."""

    ids: list
    units: np.ndarray
    radii: np.ndarray
    rows: np.ndarray

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """The most similar that a member can be to each unit query: one row a query."""
        angle = np.arccos(np.clip(unit @ self.units.T, -1, 1))
        return np.cos(np.maximum(0.0, angle - self.radii - MARGIN))

    def first(self, bounds: np.ndarray, need: int) -> np.ndarray:
        """Marks the cells to read first: those of the highest bounds that hold the rows needed."""
        order = np.argsort(-bounds, kind="stable")
        ahead = np.cumsum(self.rows[order]) - self.rows[order]
        marks = np.zeros(len(self.ids), bool)
        marks[order[ahead < need * FIRST_ROWS]] = True
        return marks


def read_cells(radii: DataFrame, centroids: DataFrame, most: int = 1_000_000) -> Cells:
    """The cells of a table on the driver, up to a million of them; radii of several parts of a table are joined to the largest."""
    rows = radii.groupBy("centroid_id").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).join(centroids, "centroid_id", "left").orderBy("centroid_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} cells")
    dim = max((len(r["centroid"]) for r in rows if r["centroid"] is not None), default=1)
    units = np.array([r["centroid"] or [0.0] * dim for r in rows], float).reshape(len(rows), dim)
    units /= np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-300)
    return Cells([r["centroid_id"] for r in rows], units, np.array([r["radius"] for r in rows], float), np.array([r["n"] for r in rows], np.int64))


def store_radii(assigned: DataFrame, centroids: DataFrame, path: str, part: str) -> None:
    """Keep the radii of one part of a store beside it."""
    cell_radii(assigned, centroids).write.mode("overwrite").parquet(f"{path}/cells/{part}")


def stored_cells(spark: SparkSession, path: str) -> Cells:
    """The cells of a stored table.  Parts whose radii aren't there yet get them now."""
    table = Table(spark, path)
    snapshot = table.snapshot()
    centroids = table.read_centroids(CENTROID, snapshot)
    jvm = spark._jvm
    radii = spark.createDataFrame([], _CELL)
    for part in snapshot.parts:
        folder = f"{path}/cells/{part.folder}"
        done = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            store_radii(table.read(snapshot, [part]), centroids, path, part.folder)
        own = spark.read.schema(_CELL).parquet(folder)
        radii = radii.unionByName(own.where(F.col("centroid_id").isNull() | ~F.col("centroid_id").isin(list(part.without))) if part.without else own)
    return read_cells(radii, centroids)


def _within(assigned: DataFrame, cells: Cells, marks: np.ndarray) -> DataFrame:
    """The members of the marked cells; stored by centroid, only those partitions are read."""
    ids = [i for i, m in zip(cells.ids, marks) if m]
    named = [i for i in ids if i is not None]
    test = F.col("centroid_id").isin(named) if named else F.lit(False)
    return assigned.where(test | F.col("centroid_id").isNull() if len(named) < len(ids) else test)


def _unit(vector: Sequence[float], cells: Cells) -> np.ndarray:
    unit = np.array(vector, float)
    unit = unit / max(float(np.linalg.norm(unit)), 1e-300)
    return unit if len(cells.ids) == 0 or len(unit) == cells.units.shape[1] else np.resize(unit, cells.units.shape[1])


def _two_passes(assigned: DataFrame, cells: Cells, vector: Sequence[float], count: int, offset: int, key: str, find, merge) -> tuple[DataFrame, int]:
    """The page of results, and how many cells were read for it."""
    bounds = cells.bounds(_unit(vector, cells)[None])[0] if cells.ids else np.empty(0)
    need = count + offset
    marks = cells.first(bounds, need)
    spark = assigned.sparkSession
    schema = f"{key} {assigned.schema[key].dataType.simpleString()}, similarity double"
    found = [tuple(r) for r in find(_within(assigned, cells, marks), need).collect()]
    last = found[-1][1] if len(found) == need and found else -math.inf
    more = (bounds >= last) & ~marks
    if more.any() and need:
        found += [tuple(r) for r in find(_within(assigned, cells, more), need).collect()]
    return top(merge(spark.createDataFrame(found, schema)), count, offset, key), int((marks | more).sum())


def bounded_search(assigned: DataFrame, cells: Cells, vector: Sequence[float], count: int = 20, offset: int = 0, key: str = "vec_id") -> tuple[DataFrame, int]:
    """What `search` finds, and how many cells were read.  A page's rows pass through the driver."""
    return _two_passes(assigned, cells, vector, count, offset, key, lambda rows, need: top(scored(rows, vector).select(key, "similarity"), need, 0, key), lambda found: found)


def bounded_documents(assigned: DataFrame, cells: Cells, vector: Sequence[float], count: int = 20, offset: int = 0) -> tuple[DataFrame, int]:
    """What `search_documents` finds, and how many cells were read."""
    best = lambda found: found.groupBy("document_id").agg(F.max("similarity").alias("similarity"))
    return _two_passes(assigned, cells, vector, count, offset, "document_id", lambda rows, need: search_documents(rows, vector, need), best)


def bounded_batch(assigned: DataFrame, cells: Cells, queries: DataFrame, k: int = 20, key: str = "vec_id", query_key: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """What `search_batch` finds for many queries, and (query_id, cells) read for each of them.

    Both passes meet the embeddings for all queries at once.
    """
    spark = assigned.sparkSession
    read: dict[int, int] = {}

    def first(ids: list, unit: np.ndarray) -> np.ndarray:
        bounds = cells.bounds(unit)
        marks = np.array([cells.first(b, k) for b in bounds]).reshape(len(ids), len(cells.ids))
        read.update(zip(ids, marks.sum(1).tolist()))
        return marks

    found = search_batch(assigned, queries, k, key, query_key, probes=(cells.ids, first))
    ends = {r[query_key]: r["similarity"] for r in found.where(F.col("rank") == k).select(query_key, "similarity").collect()}

    def rest(ids: list, unit: np.ndarray) -> np.ndarray:
        bounds = cells.bounds(unit)
        marks = np.array([cells.first(b, k) for b in bounds]).reshape(len(ids), len(cells.ids))
        last = np.array([ends.get(i, -math.inf) for i in ids])
        more = (bounds >= last[:, None]) & ~marks
        for i, n in zip(ids, more.sum(1).tolist()):
            read[i] += n
        return more

    late = search_batch(assigned, queries, k, key, query_key, probes=(cells.ids, rest))
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("similarity"), key))
    both = found.drop("rank").unionByName(late.drop("rank")).withColumn("rank", place.cast("long")).where(F.col("rank") <= k)
    return both, spark.createDataFrame(sorted(read.items()), f"{query_key} long, cells long")
