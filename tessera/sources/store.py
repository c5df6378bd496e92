"""Stored tables: documents by tenant, embeddings by tenant and centroid, both under a log of commits; any JDBC relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CENTROID, DOCUMENT
from .commits import Conflict, Snapshot, Table

TENANT = ("owner", "category")


def read_documents(spark: SparkSession, path: str, snapshot: Snapshot | None = None) -> DataFrame:
    """The stored documents; a store that doesn't exist yet is empty."""
    table = Table(spark, path)
    snapshot = snapshot or table.snapshot()
    return table.read(snapshot).select(*DOCUMENT.names) if snapshot.version else spark.createDataFrame([], DOCUMENT)


def document_id(owner: str = "owner", category: str = "category", name: str = "name"):
    """The 63-bit hash of tenant and name."""
    return F.xxhash64(owner, category, name).bitwiseAND(F.lit((1 << 63) - 1))


def append_documents(documents: DataFrame, path: str, base: Snapshot | None = None, batch: tuple[str, int] | None = None) -> Snapshot:
    """Add (name, external_id, document, owner, category).

    ``base`` is the version that the rows were compared with.  Names that another import has committed since then are left out,
    so two imports at once add a name once.
    """
    spark = documents.sparkSession
    table = Table(spark, path)
    keys = [*TENANT, "name"]

    def again(rows: DataFrame, older: Snapshot, newer: Snapshot) -> DataFrame:
        added = newer.since(older)
        return rows.join(table.read(newer, added).select(*keys), keys, "left_anti") if added else rows

    return table.append(documents.withColumn("document_id", document_id()).select(*DOCUMENT.names), TENANT, again, base, batch)


def append_batch(documents: DataFrame, path: str, stream: str, number: int) -> None:
    """Add a stream's batch of new documents, once however often it is run; an empty batch leaves the store as it is."""
    table = Table(documents.sparkSession, path)
    base = table.snapshot()
    if base.batches.get(stream, -1) < number:
        append_documents(documents, path, base, (stream, number))
    else:
        documents.write.format("noop").mode("overwrite").save()  # its state is still to be stored


def _layout(embeddings: DataFrame) -> tuple[DataFrame, list[str]]:
    """Embeddings with a ``centroid_id``, null where they have none, and what they are partitioned by."""
    rows = embeddings if "centroid_id" in embeddings.columns else embeddings.withColumn("centroid_id", F.lit(None))
    rows = rows.withColumn("centroid_id", F.col("centroid_id").cast("long"))
    return rows, [c for c in (*TENANT, "centroid_id") if c in rows.columns]


def append_embeddings(embeddings: DataFrame, path: str, key: str = "document_id", column: str = "embedding", base: Snapshot | None = None, unless_stored: bool = False) -> Snapshot:
    """Add embeddings, assigned to the store's centroids if it has any.

    If centroids are swapped meanwhile the rows are assigned anew; with ``unless_stored`` those whose key another writer has committed meanwhile are left out.
    """
    from ..operators.centroids import assign  # assignment is an operator over what is stored here

    spark = embeddings.sparkSession
    table = Table(spark, path)
    base = base or table.snapshot()

    def placed(rows: DataFrame, snapshot: Snapshot) -> DataFrame:
        return rows if snapshot.centroids is None else assign(rows.drop("centroid_id"), table.read_centroids(CENTROID, snapshot), key, column)

    def again(rows: DataFrame, older: Snapshot, newer: Snapshot) -> DataFrame:
        # After a swap every folder is another one.
        added = newer.since(older) if newer.centroids == older.centroids else newer.parts
        if unless_stored and added:
            rows = rows.join(table.read(newer, added).select(key).distinct(), key, "left_anti")
        return rows if newer.centroids == older.centroids else placed(rows, newer)

    rows, by = _layout(placed(embeddings, base))
    return table.append(rows, by, again, base)


def write_version(assigned: DataFrame, centroids: DataFrame, path: str, base: Snapshot | None = None, key: str = "document_id", column: str = "embedding") -> int:
    """Swap all embeddings and their centroids for others, as one commit; returns the version.

    Embeddings that were added since ``base`` are assigned to the new centroids and stay; if others have swapped the centroids meanwhile, `Conflict` is raised.
    """
    from ..operators.centroids import assign

    table = Table(assigned.sparkSession, path)
    base = base or table.snapshot()
    rows, by = _layout(assigned)
    rows = rows.select(*[c for c in rows.columns if c not in by], *by)
    parts, swapped = [table.write(rows, by)], table.write(centroids.select(*CENTROID.names), folder="centroids")
    seen = base
    for _ in range(10):
        try:
            return table.commit(seen, parts, schema=rows.schema.json(), by=tuple(by), centroids=swapped).version
        except Conflict:
            newer = table.snapshot()
            if newer.centroids != seen.centroids:
                raise
            late = table.read(newer, newer.since(seen)).drop("centroid_id")
            parts.append(table.write(assign(late, centroids, key, column).select(*rows.columns), by))
            seen = newer
    raise Conflict(f"{path}: no commit")


def read_embeddings(spark: SparkSession, path: str, snapshot: Snapshot | None = None) -> DataFrame:
    return Table(spark, path).read(snapshot)


def read_centroids(spark: SparkSession, path: str, snapshot: Snapshot | None = None) -> DataFrame:
    return Table(spark, path).read_centroids(CENTROID, snapshot)


def stored_counts(spark: SparkSession, documents: str, embeddings: str) -> dict[str, int]:
    """Rows of the stored tables, from their logs alone."""
    vectors = Table(spark, embeddings).snapshot()
    return {"embeddings": vectors.rows, "documents": Table(spark, documents).snapshot().rows, "centroids": vectors.centroids.rows if vectors.centroids else 0}


def replace_rows(rows: DataFrame, path: str) -> Snapshot:
    """Make a table hold these rows and no others, in one commit."""
    table = Table(rows.sparkSession, path)
    part = table.write(rows)
    while True:
        try:
            return table.commit(table.snapshot(), [part], schema=rows.schema.json(), by=())
        except Conflict:
            continue


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return Table(spark, path).read()


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, pieces: int = 8, **options) -> DataFrame:
    """A relational table, over the connection options given; with an integer ``column`` and its ``bounds`` in ``pieces`` queries side by side."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column is not None and bounds is not None:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=pieces)
    return reader.load()


def append_jdbc(rows: DataFrame, url: str, table: str, **options) -> None:
    """Append to a relational table, over the connection options given; Spark writes a partition in a transaction."""
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def write_json(rows: DataFrame, path: str, compression: str = "zstd") -> None:
    rows.write.mode("append").option("compression", compression).json(path)
