"""Sharding by longest-processing-time scheduling.

Rows of equal text form a group that stays together.  Groups are scheduled by falling size, each to the least loaded
shard, which a heap gives.  Every group is scheduled, in a number of steps that doesn't depend on the corpus:

* a group of at least ``1 / (fineness * shards)`` of all bytes or rows is an item by itself (there are at most ``2 * fineness * shards``);
* smaller groups are classes of sizes that agree in their first ``SIZE_BITS`` bits (under 1 % apart), all of a class at its mean size.  A class
  of n groups is n items of one size in a row; which shard gets how many of them follows from the loads in one step, as n turns of the heap would give it.

Groups of a class are numbered in the order of their hash, over key ranges and prefix sums, and the numbers cut into as many for each
shard.  A group larger than a shard's even part can't be split without separating equal texts: it then fills a shard of its own.

Null texts count as empty ones (size 8, CRC 0) and group with them.  Repeated rows are counted before they are dealt, and each gets a slot.  An empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import copies, staged

FINENESS = 256
SIZE_BITS = 8


def lpt(items: Iterable[tuple[str, int]], n_shards: int) -> dict[str, int]:
    """Shard of each (key, size): by falling size, ties by key, to the least loaded shard, ties to the lowest number."""
    return {key: placed.index(1) for key, placed in lpt_many(((k, s, 1) for k, s in items), n_shards).items()}


def lpt_many(items: Iterable[tuple[str, float, int]], n_shards: int) -> dict[str, list[int]]:
    """How many of each (key, size, n), n items of one size, each shard gets: by falling size, each item to the least loaded shard."""
    loads = [0.0] * n_shards
    out = {}
    for key, size, n in sorted(items, key=lambda x: (-x[1], x[0])):
        counts = [0] * n_shards
        if n > 4 * n_shards and size > 0:
            # All turns of the heap but the last few: as many as fit under a common level.
            low, high = min(loads), max(loads) + size * n
            for _ in range(100):
                level = (low + high) / 2
                if sum(max(0, math.floor((level - x) / size)) for x in loads) > n - n_shards:
                    high = level
                else:
                    low = level
            counts = [max(0, math.floor((low - x) / size)) for x in loads]
        heap = [(load + c * size, shard) for shard, (load, c) in enumerate(zip(loads, counts))]
        heapq.heapify(heap)
        for _ in range(n - sum(counts)):
            load, shard = heap[0]
            counts[shard] += 1
            heapq.heapreplace(heap, (load + size, shard))
        loads = [load + c * size for load, c in zip(loads, counts)]
        out[key] = counts
    return out


def assign_shards(docs: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text", fineness: int = FINENESS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; slots of a shard count from 0 without gaps."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.md5(body).alias("group"))
    # Rows of one id and text are one row with a number until slots are dealt.
    slim = staged(slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("copies")), "shard")
    total, rows, most = slim.agg(F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    share = fineness * n_shards
    drop = F.greatest(F.lit(0), F.floor(F.log2("bytes")).cast("int") - F.lit(SIZE_BITS - 1))
    groups = slim.groupBy("group").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("n"))
    alone = (F.col("bytes") * F.lit(share) >= F.lit(total)) | (F.col("n") * F.lit(share) >= F.lit(rows))
    size_class = F.floor(F.col("bytes") / F.pow(F.lit(2.0), drop)) * F.pow(F.lit(2.0), drop)
    groups = staged(groups.withColumn("class", F.when(~alone, size_class.cast("long"))).withColumn("range", F.pmod(F.xxhash64("group"), F.lit(max(1, math.isqrt(rows))))), "shard-groups")

    # At most 2 * fineness * n_shards groups and some thousands of classes come to the driver.
    singles = [(r["group"], float(r["bytes"]), 1) for r in groups.where("class IS NULL").collect()]
    classes = [(str(r["class"]), r["mean"], r["n"]) for r in groups.where("class IS NOT NULL").groupBy("class").agg(F.avg("bytes").alias("mean"), F.count(F.lit(1)).alias("n")).collect()]
    placed = lpt_many(singles + classes, n_shards)
    own = spark.createDataFrame([(k, placed[k].index(1)) for k, _, _ in singles], "`group` string, own int")
    ends = spark.createDataFrame([(int(k), [sum(placed[k][: s + 1]) for s in range(n_shards)]) for k, _, _ in classes], "class long, ends array<long>")

    small = groups.where("class IS NOT NULL")
    earlier = Window.partitionBy("class").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = small.groupBy("class", "range").agg(F.count(F.lit(1)).alias("in_range"))
    ranges = ranges.select("class", "range", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("ahead"))
    nth = F.row_number().over(Window.partitionBy("class", "range").orderBy("group"))
    numbered = small.withColumn("nth", nth).join(ranges, ["class", "range"]).join(F.broadcast(ends), "class")
    number = F.col("ahead") + F.col("nth")
    shared = numbered.select("group", F.size(F.filter("ends", lambda e: e < number)).alias("shard"))

    # Large groups are looked up, so none of those that are joined holds many rows.
    looked_up = slim.join(F.broadcast(own), "group", "left")
    out = looked_up.where("own IS NOT NULL").select(*slim.columns, F.col("own").alias("shard")).unionByName(looked_up.where("own IS NULL").join(shared, "group").select(*slim.columns, "shard"))
    # A shard's slots are counted in about as many pieces as a piece has rows.
    pieces = max(1, math.isqrt(rows // n_shards))
    out = staged(out.withColumn("piece", F.pmod(F.xxhash64("doc_id", "group"), F.lit(pieces))), "shard-rows")
    counts = out.groupBy("shard", "piece").agg(F.sum("copies").alias("in_piece"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "piece", F.coalesce(F.sum("in_piece").over(before), F.lit(0)).alias("ahead"))
    upto = F.sum("copies").over(Window.partitionBy("shard", "piece").orderBy("doc_id", "group").rowsBetween(Window.unboundedPreceding, 0))
    first = out.withColumn("upto", upto).join(counts, ["shard", "piece"]).withColumn("first", F.col("ahead") + F.col("upto") - F.col("copies"))
    return copies(first, most, "copies").select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("copy")).cast("long").alias("slot"))
