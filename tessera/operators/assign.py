"""The nearest centroid of every embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import cosine

#: Bytes of centroids that are broadcast at most.
BROADCAST_BYTES = 256 << 20


def assign(embeddings: DataFrame, centroids: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Embeddings with the ``centroid_id`` of the most similar centroid, ties to the lowest id.

    Centroids are measured first: a broadcast of one array of them all is only made up to ``BROADCAST_BYTES``.
    """
    size = centroids.agg(F.coalesce(F.sum(F.size("centroid") * 8 + 16), F.lit(0))).first()[0]
    if size > BROADCAST_BYTES:
        raise ValueError(f"{size} bytes of centroids; cluster the centroids first")
    every = centroids.agg(F.array_sort(F.collect_list(F.struct("centroid_id", "centroid"))).alias("__every"))
    near = F.transform("__every", lambda c: F.struct(cosine(F.col(column), c["centroid"]).alias("s"), (-c["centroid_id"]).alias("i")))
    return embeddings.crossJoin(F.broadcast(every)).withColumn("centroid_id", -F.array_max(near)["i"]).drop("__every")
