"""Approximate neighbours by random projections, the alternative to probing centroids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import norm


def lsh_search(embeddings: DataFrame, vector: Sequence[float], count: int = 20, tables: int = 8, bucket: float = 0.5, seed: int = 1, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, similarity) of about the ``count`` nearest vectors by cosine; all are brought to unit length first, vectors without length are left out."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    length = norm(F.col(column))
    unit = F.transform(F.col(column).cast("array<double>"), lambda x: x / length)
    rows = embeddings.where(length > 0).select(key, array_to_vector(unit).alias("features"))
    size = float(np.linalg.norm(vector)) or 1.0
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", numHashTables=tables, bucketLength=bucket, seed=seed).fit(rows)
    found = model.approxNearestNeighbors(rows, Vectors.dense([float(x) / size for x in vector]), count, distCol="distance")
    return found.select(key, (1 - F.col("distance") * F.col("distance") / 2).alias("similarity")).orderBy(F.desc("similarity"), key)
