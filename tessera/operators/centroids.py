"""Centroids: means of groups, KMeans refresh, assignment and probing."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import cosine, norm
from ..schema import CENTROID
from ..sources.commits import Table
from ..sources.store import write_version
from .assign import assign
from .cells import MARGIN, stored_cells
from .search import literal_vector, search, search_batch

#: Share of all centroids that are probed by default.
PROBE_SHARE = 0.8


def group_means(embeddings: DataFrame, group: str = "label", column: str = "embedding") -> DataFrame:
    """(centroid_id, dim, mean): sums by group and dimension are combined in every task before they are shuffled."""
    cells = embeddings.select(F.col(group).alias("centroid_id"), F.posexplode(column).alias("dim", "x"))
    return cells.groupBy("centroid_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def as_vectors(means: DataFrame) -> DataFrame:
    """(centroid_id, centroid) from (centroid_id, dim, mean)."""
    cells = F.array_sort(F.collect_list(F.struct("dim", "mean")))
    return means.groupBy("centroid_id").agg(F.transform(cells, lambda c: c["mean"]).alias("centroid"))


def kmeans(embeddings: DataFrame, k: int, seed: int = 1, iterations: int = 20, column: str = "embedding") -> DataFrame:
    """(centroid_id, centroid) of a cosine KMeans over all embeddings."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    # A vector of no length has no direction to learn from.
    vectors = embeddings.where(norm(F.col(column)) > 0).select(array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations, distanceMeasure="cosine").fit(vectors)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return embeddings.sparkSession.createDataFrame(rows, "centroid_id long, centroid array<double>")


def default_probes(n: int) -> int:
    """How many of n centroids are probed unless a caller says otherwise.

    Vectors without clusters need most of them: with ``PROBE_SHARE`` of 10 centroids 0.93 of the 20 nearest are found among vectors
    that are as good as random, the hardest case; with clusters fewer would do.
    """
    return math.ceil(PROBE_SHARE * n)


def probe(centroids: DataFrame, vector: Sequence[float], n: int | None = None) -> list[int]:
    """Ids of the n centroids most similar to a vector."""
    near = centroids.select("centroid_id", cosine(F.col("centroid"), literal_vector(vector)).alias("s"))
    return [r[0] for r in near.orderBy(F.desc("s"), "centroid_id").limit(default_probes(centroids.count()) if n is None else n).collect()]


def probed(assigned: DataFrame, centroids: DataFrame, vector: Sequence[float], n_probe: int | None = None) -> DataFrame:
    """The embeddings of the nearest centroids; stored by centroid, only those partitions are read."""
    return assigned.where(F.col("centroid_id").isin(probe(centroids, vector, n_probe)))


def probed_search(assigned: DataFrame, centroids: DataFrame, vector: Sequence[float], count: int = 20, offset: int = 0, n_probe: int | None = None, key: str = "vec_id") -> DataFrame:
    """Search among the embeddings of the nearest centroids; `search` is the exact way."""
    return search(probed(assigned, centroids, vector, n_probe), vector, count, offset, key)


def probed_batch(assigned: DataFrame, centroids: DataFrame, queries: DataFrame, k: int = 20, n_probe: int | None = None, key: str = "vec_id", most: int = 100_000) -> DataFrame:
    """`search_batch` in which each query meets the embeddings of its nearest centroids alone."""
    found = centroids.orderBy("centroid_id").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} centroids; cluster the centroids first")
    ids, vectors = [r["centroid_id"] for r in found], np.array([r["centroid"] for r in found], np.float64).reshape(len(found), -1)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    n = default_probes(len(ids)) if n_probe is None else n_probe

    def nearest(_: list, unit: np.ndarray) -> np.ndarray:
        near = unit @ vectors.T
        chosen = np.lexsort((np.broadcast_to(ids, near.shape), -near), axis=1)[:, :n]
        marks = np.zeros(near.shape, bool)
        np.put_along_axis(marks, chosen, True, 1)
        return marks

    return search_batch(assigned, queries, k, key, probes=(ids, nearest))


def refresh(spark: SparkSession, path: str, k: int, seed: int = 1, key: str = "document_id") -> int:
    """Retrain the centroids of a store, assign its embeddings anew and swap both in; returns the new version.

    Readers go on with the version before until the new one is committed, an interrupted refresh leaves no trace for them, and embeddings
    that an import adds meanwhile stay.
    """
    table = Table(spark, path)
    base = table.snapshot()
    rows = table.read(base)
    centroids = kmeans(rows, k, seed)
    return write_version(assign(rows.drop("centroid_id"), centroids, key), centroids, path, base, key)


def refresh_changed(spark: SparkSession, path: str, grown: float = 0.2, most: int | None = None, least: int = 0, seed: int = 1, key: str = "document_id", column: str = "embedding") -> dict[str, int]:
    """Bring centroids up to date where embeddings were added, and rewrite only the cells that this can change.

    A cell that has grown by the share ``grown`` since its centroids were made moves its centroid towards the mean of what is new, by their shares of the cell; one of
    more than ``most`` embeddings is split in two; one of fewer than ``least`` is given up.  Another cell is read and assigned anew only if
    a centroid that is new or has moved lies within twice the cell's radius, since no member can be nearer to one beyond that.  So the store holds what
    assigning every embedding to these centroids gives.  Returns how many cells there are, changed and were rewritten, and the version.
    """
    table = Table(spark, path)
    base = table.snapshot()
    if base.centroids is None:
        raise ValueError("the store has no centroids yet")
    cells = stored_cells(spark, path)
    centroids = table.read_centroids(CENTROID, base)
    since = next(s for v in table.versions() if (s := table.snapshot(v)).centroids == base.centroids)
    fresh = table.read(base, base.since(since))
    new = {r["centroid_id"]: r["n"] for r in fresh.groupBy("centroid_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = dict(zip(cells.ids, cells.rows.tolist()))
    vectors = {r["centroid_id"]: np.array(r["centroid"], float) for r in centroids.collect()}
    now, changed = dict(vectors), set()
    large = [c for c, n in rows.items() if c is not None and most is not None and n > most]
    moved = [c for c, n in new.items() if c is not None and c not in large and n >= grown * max(1, rows[c] - n)]
    if moved:
        scaled = F.transform(column, lambda x: x.cast("double") / F.nullif(norm(F.col(column)), F.lit(0.0)))
        means = as_vectors(group_means(fresh.where(F.col("centroid_id").isin(moved)).withColumn(column, scaled).where(F.col(column)[0].isNotNull()), "centroid_id", column))
        for r in means.collect():
            c, share = r["centroid_id"], new[r["centroid_id"]] / rows[r["centroid_id"]]
            was = vectors[c] / max(float(np.linalg.norm(vectors[c])), 1e-300)
            now[c] = (1 - share) * was + share * np.array(r["centroid"], float)
            changed.add(c)
    for c in large:
        halves = kmeans(table.read(base).where(F.col("centroid_id") == c), 2, seed, column=column).orderBy("centroid_id").collect()
        if len(halves) == 2:
            now[c], now[max(now) + 1] = (np.array(h["centroid"], float) for h in halves)
            changed |= {c, max(now)}
    gone = sorted(c for c in now if c not in changed and rows.get(c, 0) < least)[: len(now) - 1]
    for c in gone:
        del now[c]
    if not changed and not gone:
        return {"cells": len(vectors), "changed": 0, "rewritten": 0, "version": base.version}
    # Cells that may lose a member to a centroid that is new or has moved.
    unit = lambda v: v / max(float(np.linalg.norm(v)), 1e-300)
    targets = np.array([unit(now[c]) for c in sorted(changed)])
    touched = {c for c in cells.ids if c is not None and (c in changed or c in gone)}
    for c, radius in zip(cells.ids, cells.radii.tolist()):
        if c is not None and c not in touched and len(targets):
            nearest = float(np.arccos(np.clip(targets @ unit(vectors[c]), -1, 1)).min())
            if nearest / 2 <= radius + MARGIN:
                touched.add(c)
    after = spark.createDataFrame([(c, [float(x) for x in v]) for c, v in sorted(now.items())], CENTROID)
    stays = F.col("centroid_id").isin(sorted(touched))
    part = table.write(assign(table.read(base).where(stays).drop("centroid_id"), after, key, column).select(*[f for f in table.read(base).columns]), base.by)
    swapped = table.write(after, folder="centroids")
    left = {f"part={r['part']}": r["n"] for r in table.counts(base, "centroid_id").where(F.col("centroid_id").isNull() | ~stays).groupBy("part").agg(F.sum("n").alias("n")).collect()}
    parts = [replace(p, rows=left.get(p.folder, 0), without=tuple(sorted({*p.without, *touched}))) for p in base.parts]
    version = table.commit(base, [*parts, part], centroids=swapped).version
    return {"cells": len(vectors), "changed": len(changed) + len(gone), "rewritten": len(touched), "version": version}
