"""Several vectors a document, one a paragraph, and the paragraph for which a document was found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paragraphs import LENGTH, paragraphs
from .embed import Embedder, embed
from .search import PUSHED_IDS, scored, search_documents


def paragraph_rows(documents: DataFrame, length: int = LENGTH, document_id: str = "document_id", text: str = "document", keep: Sequence[str] = ()) -> DataFrame:
    """(document_id, start, paragraph) and the columns in ``keep``, in the scan's stage."""
    rows = documents.select(F.col(document_id).alias("document_id"), *keep, F.explode(paragraphs(F.col(text), length)).alias("p"))
    return rows.select("document_id", *keep, F.col("p.start").alias("start"), F.col("p.text").alias("paragraph"))


def embed_paragraphs(documents: DataFrame, embedder: Embedder, length: int = LENGTH, keep: tuple[str, ...] = (), **columns) -> DataFrame:
    """(document_id, embedding, start, length) and the columns in ``keep``: a vector for each paragraph."""
    rows = paragraph_rows(documents, length, keep=keep, **columns).withColumn("length", F.length("paragraph").cast("long"))
    return embed(rows, embedder, text="paragraph", keep=("start", "length", *keep))


def best_paragraphs(embeddings: DataFrame, vector: Sequence[float], count: int = 20, offset: int = 0) -> DataFrame:
    """(document_id, similarity, start, length) of the nearest documents: each with its nearest paragraph, the first of equals.

    Documents are found without a shuffle; then only the vectors of those found are compared again.
    """
    found = search_documents(embeddings, vector, count, offset)
    ids = [r[0] for r in found.select("document_id").collect()]
    rows = embeddings.where(F.col("document_id").isin(ids)) if len(ids) <= PUSHED_IDS else embeddings.join(F.broadcast(found.select("document_id")), "document_id", "left_semi")
    best = F.max_by(F.struct("start", "length"), F.struct("similarity", (-F.col("start")).alias("s"))).alias("p")
    return scored(rows, vector).groupBy("document_id").agg(F.max("similarity").alias("similarity"), best).select("document_id", "similarity", "p.start", "p.length")


def read_paragraphs(best: DataFrame, documents: DataFrame, document_id: str = "document_id", text: str = "document") -> DataFrame:
    """``best`` with the paragraphs' texts."""
    return best.join(documents.select(F.col(document_id).alias("document_id"), F.col(text).alias("__text")), "document_id").withColumn(
        "paragraph", F.substring("__text", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))).drop("__text")
