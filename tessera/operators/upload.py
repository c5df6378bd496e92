"""An import as a whole: pages to new documents, their embeddings, and both stored by tenant and centroid."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.commits import Table
from ..sources.scratch import scratch_path
from ..sources.store import TENANT, append_documents, append_embeddings, read_documents, replace_rows
from .embed import UPLOAD_SECONDS, Embedder, embed_or_report
from .importer import new_documents


def missing_embeddings(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Stored documents without an embedding: those of an import that was interrupted between its two writes, and those whose upload failed."""
    return documents.join(embeddings.select("document_id").distinct(), "document_id", "left_anti")


def embed_and_store(documents: DataFrame, embedder: Embedder, path: str, failed: str | None = None, parallel: int | None = None, attempts: int = 3, seconds: float = UPLOAD_SECONDS, base=None) -> None:
    """Embed stored documents and add the vectors, by tenant and by the nearest of the store's centroids.

    A text that the model keeps failing on doesn't stop the others: it has no vector, so the next import tries it again, and the table at ``failed``
    holds the ids and errors of the last run.
    """
    spark = documents.sparkSession
    done = embed_or_report(documents, embedder, attempts=attempts, parallel=parallel, seconds=seconds, keep=TENANT)
    # Written once, as the model's answers are needed twice.
    answers = scratch_path(spark, "answers")
    done.write.parquet(answers)
    rows = spark.read.schema(done.schema).parquet(answers)
    append_embeddings(rows.where("error IS NULL").drop("error"), path, base=base, unless_stored=True)
    if failed is not None:
        replace_rows(rows.where("error IS NOT NULL").select("document_id", *TENANT, "error"), failed)


def import_pages(pages: DataFrame, documents: str, embeddings: str, embedder: Embedder, owner: str = "wikipedia", category: str = "wikipedia", service=None, failed: str | None = None, parallel: int | None = None, attempts: int = 3, seconds: float = UPLOAD_SECONDS, sequence: str = "ingest_seq") -> None:
    """Add the pages' new documents to the store at ``documents`` and their vectors to the one at ``embeddings``.

    A second run on the same pages adds nothing, and one after an interruption embeds what the first one left.  Imports can run at once and
    beside a refresh.  Of pages of one name the first by ``sequence`` counts; a dump of several files has no order among them, so ``page_id`` is the one
    to take there.  ``parallel`` bounds how many tasks call the model at once (`Settings.upload_parallelism`).  A ``service`` keeps no counts meanwhile.
    """
    spark = pages.sparkSession
    mine = lambda df: df.where((F.col("owner") == owner) & (F.col("category") == category))
    with service.importing() if service is not None else nullcontext():
        before = Table(spark, documents).snapshot()
        append_documents(new_documents(pages, mine(read_documents(spark, documents, before)), owner, category, sequence), documents, before)
        rows, vectors = mine(read_documents(spark, documents)), Table(spark, embeddings)
        base = vectors.snapshot()
        embed_and_store(missing_embeddings(rows, mine(vectors.read(base))) if base.version else rows, embedder, embeddings, failed, parallel, attempts, seconds, base)
