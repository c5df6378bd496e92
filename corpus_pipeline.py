"""A corpus from documents to shards, in five stages.

1. quality: fits the quality classifier on the labelled rows of its input whose id's CRC-32 doesn't leave 2 modulo 4 and drops what scores under 0.7.
2. near_dedup: SimHash near-dedup over five-word shingles, each pair within the radius checked for a Jaccard similarity of 0.8 or more;
   the document of the smallest id of every component stays.
3. decontaminate: drops documents that leak a benchmark item.
4. mix: repeats or drops documents so that the sources meet their target weights; a repeated document is a repeated row.
5. shard: one row per row of the mix with its shard and slot, equal texts together.

Each stage's result is written as Parquet and read again, so a lost executor never costs more than the stage at work.  What a stage itself has
staged goes when its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, near_copies, quality, sharding
from tessera.llm._common import drop_staged, id_crc32, staged, staged_count, table

SHARDS = 24


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), id_crc32("doc_id") % 4 != 2)
    return quality.keep_quality(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_first(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs, SHARDS)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]

#: SQL expresses neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = staged_count()
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_staged(spark, before, keep_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)
