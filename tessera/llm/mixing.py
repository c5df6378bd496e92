"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key.  Documents are range-partitioned by key within their source, sizes are
summed per range, the sums are turned into prefix sums, and a running sum inside each range completes them.
A source's budget is cut exactly where the prefix sum meets it; a budget above the source's size repeats whole epochs.

* A source of n rows is divided into about sqrt(n) key ranges of sqrt(n) rows, so neither a range nor a source's list of ranges is large.
* The key is a hash of id and text, so rows without an id, or with a repeated one, are spread like all others.  Rows of one id and text
  are interchangeable: they are counted before they are shuffled, and budgets cut between them.
* Null sources form a source of their own, last in order; null texts have size 0; an empty table gives no rows.
* Other columns of the input are ignored by `mix` and kept by `mixed_rows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, copies, staged


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(doc_id: Column, text: Column, seed: str) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(F.coalesce(text, F.lit("")))))


def source_targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """Add ``target`` to (source, n, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all sizes.  A target stops at
    ``ceiling`` times its source's size and the excess is reshared by weight.  That water level is found in one sweep over
    the sources ordered by ceiling per weight: a source is full if the level of those not yet full reaches its ceiling.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = Window.orderBy("fill", "nth").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    level = (F.col("total") * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    return (
        sources.withColumn("nth", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(ceiling))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", level)
        .withColumn("water", F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", "nth", "level"))).over(every)["level"])
        .withColumn("target", F.when(F.col("water").isNull() | (F.col("fill") <= F.col("water")), F.col("cap")).otherwise(F.col("weight") * F.col("water")))
        .select("source", "n", "source_size", "target")
    )


def _planned(docs: DataFrame, doc_id: str, text: str, source: str, seed: str, **shares) -> tuple[DataFrame, DataFrame]:
    """Slim rows, those of one id and text as one with their number n, each with the words ahead of it; and the sources' budgets."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _key(F.col(doc_id), F.col(text), seed).alias("key"))
    slim = staged(slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("n")), "mix")
    words = F.col("size") * F.col("n")
    budgets = source_targets(slim.groupBy("source").agg(F.sum("n").alias("n"), F.sum(words).alias("source_size")), **shares)
    budgets = budgets.withColumn("budget", F.floor("target")).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    ).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).withColumn("ranges", F.ceil(F.sqrt("n")))
    budgets = staged(budgets.withColumnRenamed("source", "of").withColumnRenamed("n", "rows"), "mix-budgets")
    rows = slim.join(budgets, slim["source"].eqNullSafe(budgets["of"])).drop("of").withColumn(
        "range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(2**32)))
    # Null sources meet each other again in the join below under a name that no source can have twice.
    rows = rows.withColumn("named", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    sums = rows.groupBy("named", "range").agg(F.sum(words).alias("in_range"))
    earlier = Window.partitionBy("named").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("named", "range", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("named", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum(words).over(within)).join(sums, ["named", "range"])
    return rows.withColumn("start", F.col("ahead") + F.col("upto") - words), budgets


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", **shares) -> DataFrame:
    """One row per document: (doc_id, size, source_size, target, taken), sizes in words.

    ``taken`` counts repeats, is at most ``ceiling`` times the size, and sums to ``floor(target)`` in every source:
    the document on which a budget ends is taken up to exactly that word.
    """
    rows, _ = _planned(docs, doc_id, text, source, seed, **shares)
    rows = staged(rows.select("doc_id", "size", "source_size", "target", "epochs", "rest", "start", "n"), "mix-rows")
    each = copies(rows, rows.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("copy") * F.col("size")))
    return each.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", **shares) -> DataFrame:
    """The mix itself, in the columns of ``docs``: each document as often as its source's epochs ask for.

    Texts stay whole, so the document on which a budget ends is in if at least half of it lies inside the budget.
    Documents of no words are in once if their source's first epoch is complete or reaches their place.  Only each
    source's last key is looked up, so texts are never shuffled, but for those of one id and text that a budget cuts between.
    """
    rows, budgets = _planned(docs, doc_id, text, source, seed, **shares)
    # How many of a row's copies start before the budget's end, by at least half of their words.
    room = F.col("rest") - F.ceil(F.col("size") / 2) - F.col("start")
    inside = F.when(room < 0, 0).when(F.col("size") == 0, F.col("n")).otherwise(F.least(F.col("n"), F.floor(room / F.greatest(F.col("size"), F.lit(1))) + 1))
    rows = rows.withColumn("inside", inside.cast("long")).where((F.col("inside") > 0) & (F.col("rest") > 0))
    cuts = rows.groupBy("named").agg(F.max(F.struct("key", "inside", "n")).alias("cut"))
    cuts = cuts.select(F.when(~F.col("named.none"), F.col("named.name")).alias("__mix_cut_of"), F.col("cut.key").alias("__mix_last"), F.when(F.col("cut.inside") < F.col("cut.n"), F.col("cut.inside")).alias("__mix_part"))
    marks = staged(budgets.join(cuts, budgets["of"].eqNullSafe(cuts["__mix_cut_of"]), "left").select(
        F.col("of").alias("__mix_of"), F.col("epochs").alias("__mix_epochs"), "__mix_last", "__mix_part"), "mix-cuts")
    key = _key(F.col(doc_id), F.col(text), seed)
    met = docs.join(marks, docs[source].eqNullSafe(marks["__mix_of"])).withColumn("__mix_key", key)
    split = F.coalesce((F.col("__mix_key") == F.col("__mix_last")) & F.col("__mix_part").isNotNull(), F.lit(False))
    once = F.when(F.col("__mix_key") <= F.col("__mix_last"), 1).otherwise(0)

    def repeated(kept: DataFrame, more: Column) -> DataFrame:
        taken = kept.withColumn("__mix_copy", F.explode(F.sequence(F.lit(0), (F.col("__mix_epochs") + more).cast("int"))))
        return taken.where(F.col("__mix_copy") > 0).select(*docs.columns)

    out = repeated(met.where(~split), once)
    if marks.where("__mix_part IS NOT NULL").isEmpty():
        return out
    # Equal rows that a budget cuts between: numbered by task, as many as are inside are in once more.
    equal = staged(met.where(split).withColumns({"__mix_task": F.spark_partition_id(), "__mix_at": F.monotonically_increasing_id()}), "mix-equal")
    whose = F.struct(F.col("__mix_of").isNull().alias("none"), F.coalesce("__mix_of", F.lit("")).alias("name"))
    counts = equal.groupBy(whose.alias("__mix_whose"), "__mix_task").agg(F.count(F.lit(1)).alias("__mix_here"))
    before = Window.partitionBy("__mix_whose").orderBy("__mix_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__mix_whose", "__mix_task", F.coalesce(F.sum("__mix_here").over(before), F.lit(0)).alias("__mix_ahead"))
    nth = F.row_number().over(Window.partitionBy("__mix_whose", "__mix_task").orderBy("__mix_at"))
    numbered = equal.withColumn("__mix_whose", whose).withColumn("__mix_nth", nth).join(counts, ["__mix_whose", "__mix_task"])
    return out.unionByName(repeated(numbered, F.when(F.col("__mix_ahead") + F.col("__mix_nth") <= F.col("__mix_part"), 1).otherwise(0)))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':mix:' || md5(coalesce(text, ''))) AS key FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((nth - 1) % 3 + 1)::INT] AS weight FROM sources
), filled AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS fill, (sum(source_size) OVER ())::BIGINT AS total FROM weighed
), levels AS (
  SELECT *, (total * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM filled WINDOW before AS (ORDER BY fill, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT min_by(level, nth) AS water FROM levels WHERE fill > level AND fill = (SELECT min(fill) FROM levels WHERE fill > level)
), targets AS (
  SELECT source, source_size, CASE WHEN water IS NULL OR fill <= water THEN cap ELSE weight * water END AS target FROM levels, (SELECT max(water) AS water FROM water)
), runs AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING))::BIGINT - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget % source_size - start)) ELSE 0 END)::BIGINT AS taken
FROM runs
"""
