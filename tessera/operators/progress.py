"""What an import has seen and kept: as metrics of a running plan, or as a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions import text as T


def observed(rows: DataFrame, text: str = "document") -> tuple[DataFrame, Observation]:
    """``rows`` and an observation that has their number and characters once an action has run; it costs no pass of its own."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters")), seen


def file_bytes(spark: SparkSession, files: list[str]) -> int:
    """Bytes of some files, as they are stored."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    return sum((p := path(f)).getFileSystem(conf).getFileStatus(p).getLen() for f in files)


def consumed(rows: DataFrame) -> tuple[DataFrame, Observation, int]:
    """``rows`` of a dump, an observation of their number, and the bytes of the files that they are read from."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen, file_bytes(rows.sparkSession, rows.inputFiles())


class StreamConsumed(StreamingQueryListener):
    """Adds up what a stream over a folder of dumps has read: pages, the bytes of their files, and both by batch.

    Rows are those of the query's progress; a batch's files stand in the log of the stream's checkpoint.
    """

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.spark, self.checkpoint = spark, checkpoint
        self.batches: dict[int, tuple[int, int]] = {}  # batch -> rows, bytes

    @property
    def rows(self) -> int:
        return sum(r for r, _ in self.batches.values())

    @property
    def bytes(self) -> int:
        return sum(b for _, b in self.batches.values())

    def _files(self, batch: int) -> list[str]:
        log = f"{self.checkpoint}/sources/0"
        for name in (f"{log}/{batch}", f"{log}/{batch}.compact"):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if fs.exists(path):
                stream = fs.open(path)
                try:
                    lines = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")[1:]
                finally:
                    stream.close()
                return [e["path"] for e in map(json.loads, filter(None, lines)) if e["batchId"] == batch]
        return []

    def onQueryProgress(self, event) -> None:
        p = event.progress
        ends = [json.loads(s.endOffset).get("logOffset") for s in p.sources if s.endOffset]
        if p.numInputRows and ends:
            self.batches[p.batchId] = (p.numInputRows, file_bytes(self.spark, self._files(int(ends[0]))))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def import_funnel(pages: DataFrame, stored: DataFrame, sequence: str = "ingest_seq") -> DataFrame:
    """(step, rows) left after each step of an import, in the importer's order.

    One pass over the pages: each is marked with how many steps it passes, cleaned only if it gets that far, and marks are counted by name.
    """
    name = T.trimmed(F.coalesce("title", F.lit("")))
    body = F.coalesce("text", F.lit(""))
    passed = F.when(name == "", 1).when(T.is_namespaced(name), 2).when(T.is_disambiguation(body), 3).when(T.clean_markup(body) == "", 4).otherwise(5)
    marked = pages.select(name.alias("name"), passed.alias("passed"))
    known = stored.select(F.col("name").alias("__stored")).distinct().withColumn("__known", F.lit(True))
    by_name = marked.groupBy("name").agg(*[F.count_if(F.col("passed") > k).alias(f"n{k}") for k in range(5)]).join(known, F.col("name") == F.col("__stored"), "left")
    fresh = F.when(F.col("__known").isNull(), F.col("n4")).otherwise(0)
    steps = {"pages": F.sum("n0"), "titled": F.sum("n1"), "articles": F.sum("n2"), "plain": F.sum("n3"), "cleaned": F.sum("n4"), "fresh": F.sum(fresh), "first": F.count_if(fresh > 0)}
    one = by_name.agg(*[F.coalesce(v, F.lit(0)).alias(k) for k, v in steps.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(k).cast("long").alias("rows")) for k in steps])).alias("r")).select("r.step", "r.rows")
