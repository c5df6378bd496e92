"""From pages to new documents: filter, clean, keep the first of each name, leave out what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def article_candidates(pages: DataFrame, drop_redirects: bool = False) -> DataFrame:
    """Pages with a title that aren't of another namespace nor disambiguations; cheap title tests stand before text tests."""
    name = T.trimmed(F.coalesce("title", F.lit("")))
    body = F.coalesce("text", F.lit(""))
    kept = pages.withColumn("name", name).where((F.col("name") != "") & ~T.is_namespaced(F.col("name")) & ~T.is_disambiguation(body))
    return kept.where("redirect IS NULL") if drop_redirects else kept


def clean_articles(pages: DataFrame, **options) -> DataFrame:
    """Candidates with their cleaned ``document``, where something is left of it; a generator cleans and filters, so a text is cleaned once."""
    cleaned = F.filter(F.array(T.clean_markup(F.coalesce("text", F.lit("")))), lambda d: d != "")
    return article_candidates(pages, **options).withColumn("document", F.explode(cleaned))


def first_by_name(rows: DataFrame, name: str = "name", sequence: str = "ingest_seq") -> DataFrame:
    """The first row of each name, case-sensitively; of equal sequence numbers any one row.

    One pass: each task keeps the first row of a name before anything is shuffled, so a name that many rows share costs
    one row a task.
    """
    others = [c for c in rows.columns if c != name]
    first = rows.groupBy(name).agg(F.min_by(F.struct(*others), F.col(sequence)).alias("__first"))
    return first.select(*[F.col(name) if c == name else F.col(f"__first.`{c}`").alias(c) for c in rows.columns])


def not_stored(rows: DataFrame, stored: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose name isn't among the stored names; Spark broadcasts those only while they are small."""
    return rows.join(stored.select(F.col("name").alias("__stored")).distinct(), F.col(name) == F.col("__stored"), "left_anti")


def new_documents(pages: DataFrame, stored: DataFrame | None = None, owner: str = "wikipedia", category: str = "wikipedia", sequence: str = "ingest_seq", **options) -> DataFrame:
    """(name, external_id, document, owner, category) of the pages that an import adds."""
    rows = clean_articles(pages, **options)
    if stored is not None:
        rows = not_stored(rows, stored)
    rows = first_by_name(rows.select("name", "document", sequence), sequence=sequence)
    return rows.select("name", T.article_url(F.col("name")).alias("external_id"), "document", F.lit(owner).alias("owner"), F.lit(category).alias("category"))

