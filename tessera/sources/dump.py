"""XML dumps, plain or compressed, as rows of pages; the same reader serves batch and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType, StringType

from ..schema import PAGE

_OPTIONS = {"rowTag": "page", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": "_corrupt", "attributePrefix": "_"}
_SCHEMA = StructType([*PAGE.fields, StructField("_corrupt", StringType())])


def _whole(number: Column) -> Column:
    """Whether a number is missing, empty or a whole one."""
    return number.isNull() | (F.btrim(number) == "") | F.btrim(number).rlike(r"^[+-]?\d{1,19}$")


def _kept(pages: DataFrame) -> DataFrame:
    """Pages that decode; a page with a bad number is skipped and the next one read."""
    revisions = F.coalesce(F.col("revision"), F.array().cast(ArrayType(PAGE["revision"].dataType.elementType)))
    sound = F.col("_corrupt").isNull() & _whole(F.col("ns")) & _whole(F.col("id"))
    sound &= F.forall(revisions, lambda r: _whole(r["id"]) & _whole(r["contributor"]["id"]))
    # Of several revisions the last text that is there counts; an empty one is there, a missing one isn't.
    texts = F.filter(F.transform(revisions, lambda r: r["text"]), lambda t: t.isNotNull())
    last = F.when(F.size(texts) > 0, F.element_at(texts, -1)).otherwise("")
    return pages.where(sound).select(
        F.coalesce("title", F.lit("")).alias("title"), last.alias("text"), F.btrim("id").cast("long").alias("page_id"),
        F.btrim("ns").cast("long").alias("ns"), F.col("redirect._title").alias("redirect"))


def read_pages(spark: SparkSession, path: str, skip_corrupt_files: bool = False) -> DataFrame:
    """(title, text, page_id, ns, redirect, ingest_seq) of a dump; ``ingest_seq`` follows the order within a file, and no order among several.

    A file that ends inside a compressed block fails the read, or with ``skip_corrupt_files`` gives the pages before that place.
    """
    raw = spark.read.format("xml").options(**_OPTIONS).option("ignoreCorruptFiles", str(skip_corrupt_files).lower()).schema(_SCHEMA).load(path)
    return _kept(raw).withColumn("ingest_seq", F.monotonically_increasing_id())


def stream_pages(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The same columns without ``ingest_seq``, from dumps as they arrive in a folder."""
    return _kept(spark.readStream.format("xml").options(**_OPTIONS).option("maxFilesPerTrigger", files_per_trigger).schema(_SCHEMA).load(folder))
