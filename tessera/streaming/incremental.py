"""Import of dumps as they arrive: each batch adds the documents that aren't stored yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.embed import Embedder
from ..operators.importer import new_documents
from ..operators.upload import import_pages
from ..sources.commits import Table
from ..sources.dump import stream_pages
from ..sources.store import append_documents, read_documents


def import_batch(pages: DataFrame, store: str, owner: str, category: str, embeddings: str | None = None, embedder: Embedder | None = None) -> None:
    """Add a batch of pages, with an embedder their vectors too; run again on the same pages, it adds none."""
    pages = pages.withColumn("ingest_seq", F.monotonically_increasing_id())
    if embedder is not None and embeddings is not None:
        import_pages(pages, store, embeddings, embedder, owner=owner, category=category)
        return
    before = Table(pages.sparkSession, store).snapshot()
    stored = read_documents(pages.sparkSession, store, before).where((F.col("owner") == owner) & (F.col("category") == category))
    append_documents(new_documents(pages, stored, owner, category), store, before)


def start_import(spark: SparkSession, folder: str, store: str, checkpoint: str, owner: str = "wikipedia", category: str = "wikipedia", once: bool = True, embeddings: str | None = None, embedder: Embedder | None = None, files: int = 1) -> StreamingQuery:
    """A streaming query over a folder of dumps, ``files`` of them a batch; ``once`` ends it when all that is there is imported.

    Each batch is compared with the names of the whole store, so of many small files many should make a batch.
    """
    writer = stream_pages(spark, folder, files).writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda pages, _: import_batch(pages, store, owner, category, embeddings, embedder))
    return (writer.trigger(availableNow=True) if once else writer).start()
