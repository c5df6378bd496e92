"""Summaries of found documents: lookup, prompt, and a stream of the model's characters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paragraphs import TOKEN, tokens, within_budget
from ..functions.text import SUMMARY_REQUEST, summary_prompt


def documents_by_id(documents: DataFrame, ids: Iterable[int], key: str = "document_id") -> DataFrame:
    return documents.where(F.col(key).isin([int(i) for i in ids]))


def prompts(documents: DataFrame, query: str, key: str = "document_id", text: str = "document") -> DataFrame:
    """(document_id, prompt): the query, the fixed request and the document on lines of their own."""
    return documents.select(key, summary_prompt(F.lit(query), F.col(text)).alias("prompt"))


def prompts_within(documents: DataFrame, query: str, context: int, key: str = "document_id", text: str = "document") -> DataFrame:
    """(document_id, prompt, tokens): prompts of at most ``context`` tokens, cut behind a sentence of the document; a query that leaves no room is refused."""
    room = context - len(re.findall(TOKEN, f"{query} {SUMMARY_REQUEST}"))
    if room < 0:
        raise ValueError("the query alone is longer than the model's context")
    prompt = summary_prompt(F.lit(query), within_budget(F.col(text), F.lit(room)))
    return documents.select(key, prompt.alias("prompt")).withColumn("tokens", tokens(F.col("prompt")).cast("long"))


def summary_stream(documents: DataFrame, query: str, document_id: int, chat: Callable[[str], Iterable[str]], context: int | None = None) -> Iterator[str]:
    """Characters of the model's answer about one document, as they come; LookupError without the document.

    With the model's ``context`` the document is cut to what fits.
    """
    one = documents_by_id(documents, [document_id])
    row = (prompts(one, query) if context is None else prompts_within(one, query, context)).first()
    if row is None:
        raise LookupError(f"no document {document_id}")
    for piece in chat(row["prompt"]):
        yield from piece
