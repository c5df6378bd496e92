"""Import of dumps as they arrive, with the names that have been seen as keyed state: no batch reads the store.

The state starts with the names that are stored when the stream starts for the first time.  Of a batch's pages of one name the first is kept, by file and page id;
later ones are dropped whenever they come.  The store's log holds the last batch of each stream, so a batch that is run again after an
interruption is added once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions import text as T
from ..operators.importer import clean_articles
from ..sources.commits import Table
from ..sources.dump import stream_pages
from ..sources.store import append_batch, read_documents

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfName(StatefulProcessor):
    """Lets the first row of each name through and remembers the name; names have few rows each, so rows come one by one and not as a data frame a name."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = min(rows, key=lambda r: (r["file"], r["page_id"] is None, r["page_id"] or 0))
        if not self.seen.exists():
            self.seen.update((True,))
            yield Row(name=best["name"], document=best["document"])

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def first_of_names(articles: DataFrame, stored: DataFrame) -> DataFrame:
    """(name, document): a stream of articles (name, document, file, page_id) without those whose name has been seen or is in ``stored``."""
    known = stored.select("name").distinct().groupBy("name")
    return articles.select("name", "document", "file", "page_id").groupBy("name").transformWithState(FirstOfName(), "name string, document string", "Append", "None", initialState=known)


def start_stateful_import(spark: SparkSession, folder: str, store: str, checkpoint: str, owner: str = "wikipedia", category: str = "wikipedia", once: bool = True, files: int = 1) -> StreamingQuery:
    """A streaming query over a folder of dumps, ``files`` of them a batch; ``once`` ends it when all that is there is imported."""
    pages = stream_pages(spark, folder, files).withColumn("file", F.col("_metadata.file_path"))
    stored = read_documents(spark, store).where((F.col("owner") == owner) & (F.col("category") == category))
    fresh = first_of_names(clean_articles(pages), stored)
    rows = fresh.select("name", T.article_url(F.col("name")).alias("external_id"), "document", F.lit(owner).alias("owner"), F.lit(category).alias("category"))
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: append_batch(batch, store, checkpoint, n))
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def last_batch(spark: SparkSession, store: str, checkpoint: str) -> int:
    """The last batch of a stream that is in the store; -1 before the first."""
    return Table(spark, store).snapshot().batches.get(checkpoint, -1)
