"""Connected components, in one task or by alternating large-star and small-star steps that are each written to the shared folder; one row of each component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import maybe_in, staged, text_key

#: Links that one task joins at most.
ONE_TASK = 1 << 20

#: Texts that hold more than this share of all rows are looked up by broadcast: there are at most as many as the share's inverse.
HOT_SHARE = 1 / 2000


def _stars(links: DataFrame, small_star: bool) -> DataFrame:
    """Link neighbours to the smallest of their neighbourhood: the smaller ones if ``small_star``, else the larger."""
    if small_star:
        low = links.groupBy("a").agg(F.min("b").alias("low"))
        joined = links.join(low, "a")
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    else:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("low"))
        out = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return out.where(F.col("a") > F.col("b")).distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) links -> (a, smallest node reachable) by halving paths in numpy."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
    if not parts:
        return
    ends = np.concatenate([np.concatenate(p) for p in zip(*parts)])
    nodes, place = np.unique(ends, return_inverse=True)
    root, half = np.arange(len(nodes)), len(place) // 2
    merge(root, place[:half], place[half:])
    own = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["a", "b"])


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j; ``root`` points at each set's lowest member."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def roots(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(a, b) links of longs -> (a, b) with b the smallest node reachable from a, for every a that isn't that node itself.

    Up to ``one_task`` links are joined in a task (16 bytes a link); more alternate between steps that both aggregate before they shuffle,
    and no node's neighbours are gathered in a row.  Only counts reach the driver.
    """
    links = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    state, n = None, links.count()
    if n <= one_task:
        return staged(links.repartition(1).mapInArrow(_forest, "a long, b long"), "links") if n else links
    while True:
        links = staged(_stars(_stars(links, False), True), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return links
        state = now


def keep_one(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id, null ids last; ``groups`` is (key, component) by `text_key`.

    A text that isn't in ``groups`` is a component of its own.  Rows are told apart by id and text, so different texts of one id,
    or without an id, don't stand for each other; of rows of equal id and text one stays, with any of their other columns.

    What stays is decided on (key, id) alone.  Rows whose text certainly stays, and has no copies, pass at once; the others meet the decisions by key
    and id, so copies of one text are spread.  Rows that repeat id and text so often that they'd make a task large are picked by broadcast and
    combined before they are shuffled.
    """
    slim = docs.select(text_key(text).alias("key"), F.col(doc_id).alias("id"))
    pairs = slim.groupBy("key", "id").agg(F.count(F.lit(1)).alias("n"))
    texts = pairs.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("first"), F.sum("n").alias("rows"))
    texts = staged(texts.select("key", "first.id", "first.none", "first.n", "rows"), "texts")
    member = groups.join(texts, "key")
    best = member.groupBy("component").agg(F.min(F.struct("none", "id", "key"))["key"].alias("best"))
    gone = member.join(best, "component").where("key != best").select("key", F.lit(True).alias("gone"))
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    texts = staged(texts.join(gone, "key", "left").withColumn("gone", F.coalesce("gone", F.lit(False))), "decided")
    open_texts = texts.where("gone OR rows > 1").select("key")
    # The bitmap lets the same texts through on both sides, some by chance.
    kept, _ = maybe_in(texts.where("NOT gone"), F.col("key"), open_texts)
    kept = staged(kept.select(F.col("key").alias("__text"), named("id").alias("__id"), F.col("n").alias("__n")), "kept")
    hot = F.broadcast(kept.where(F.col("__n") > F.greatest(F.lit(1), F.lit(docs.count() * HOT_SHARE))).select("__text", "__id"))
    unsure, sure = maybe_in(docs.withColumns({"__text": text_key(text), "__id": named(doc_id)}), F.col("__text"), open_texts)
    both = ["__text", "__id"]
    many = unsure.join(hot, both).dropDuplicates(both)
    few = unsure.join(hot, both, "left_anti").join(kept.select(both), both).dropDuplicates(both)
    return sure.select(docs.columns).unionByName(few.select(docs.columns)).unionByName(many.select(docs.columns))
