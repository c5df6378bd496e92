"""What the operators of this subpackage share: table access, staged tables, batch limits."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Maps A-Z to a-z in UTF-8 bytes and leaves every other byte alone.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Largest bitmap that is broadcast, in rows of 64 bits.
FILTER_WORDS = 1 << 18
#: Copies of one row that one task makes.
LOT = 4096

_own_dir: list[str] = []
_staged: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; read by Spark only, so the folder can be in any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return _own_dir[0]


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: executors lost later cost a re-read, not a recomputation.  What the step held in the driver goes at once, so an operator of
    many steps needs no more memory there than its largest step.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    df.write.option("compression", codec).parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of what finished steps hold: plans, shuffle files and broadcasts go once neither Python nor the JVM refers to them.

    Spark would only see that when the driver's memory runs short; `staged` calls this after each step.
    """
    gc.collect()
    spark._jvm.System.gc()


def staged_count() -> int:
    """How many tables `staged` has written in this process and not dropped."""
    return len(_staged)


def drop_staged(spark: SparkSession, start: int = 0, keep_last: bool = False) -> None:
    """Delete the tables that `staged` has written since there were ``start`` of them, all or all but the last.

    Call it when no result that reads them is needed any more.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    end = len(_staged) - keep_last
    for name in _staged[start:end]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del _staged[start:end]


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, whatever the length of the texts.

    The same bounds for all operators, so a plan doesn't depend on which was built last: rows of numbers reach the first, texts the second.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16384")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def id_crc32(column: str | Column) -> Column:
    """CRC-32 of an id written as text."""
    return F.crc32(F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit("")))


def text_key(text: str | Column) -> Column:
    """A 64-bit hash that tells texts apart; a null text counts as empty."""
    return F.xxhash64(F.coalesce((F.col(text) if isinstance(text, str) else text).cast("binary"), F.lit("").cast("binary")))


def maybe_in(df: DataFrame, key: Column, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: the rows whose ``key`` may be in ``members`` (one column ``key`` of hashes), all that are and some by chance, and the rows whose key isn't.

    A bitmap of 16 bits a member, of at most ``FILTER_WORDS`` words of 64 bits, is broadcast, so its size is bounded whatever the data; the fuller it
    is the more rows are among the first by chance.  What needs an exact answer joins those, and all others are spared that shuffle.
    """
    n = members.count()
    words = 1024
    while words < FILTER_WORDS and words * 4 < n:
        words *= 2
    slot = lambda c: F.pmod(c, F.lit(64 * words).cast("long"))
    place, bit = F.floor(F.col("__slot") / 64).cast("int"), F.expr("shiftleft(1L, cast(__slot % 64 as int))")
    bitmap = members.select(slot(F.col("key")).alias("__slot")).select(place.alias("__at"), bit.alias("__bit")).groupBy("__at").agg(F.bit_or("__bit").alias("__bits"))
    marked = df.withColumn("__slot", slot(key)).withColumn("__word", place)
    met = (F.col("__word") == F.col("__at")) & (F.col("__bits").bitwiseAND(bit) != 0)
    return tuple(marked.join(F.broadcast(bitmap), met, how).select(df.columns) for how in ("left_semi", "left_anti"))


def copies(rows: DataFrame, most: int, n: str = "n", copy: str = "copy") -> DataFrame:
    """Each row ``n`` times, numbered from 0 in ``copy``; ``most`` is the largest n.

    Where it is above ``LOT``, rows are first cut into lots, which are dealt out, so no task makes all copies of one row.
    """
    last = F.col(n) - 1
    if most <= LOT:
        return rows.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    lots = rows.withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(LOT).cast("long")))).repartition(partitions(rows.sparkSession))
    return lots.withColumn(copy, F.explode(F.sequence(F.col("__lot"), F.least(last.cast("long"), F.col("__lot") + LOT - 1)))).drop("__lot")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
