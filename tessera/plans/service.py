"""The service's requests and answers without a web server: a method and a body in, a status and an answer out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import CancelledError
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cells import Cells, bounded_documents
from ..operators.centroids import probed
from ..operators.embed import Embedder
from ..operators.search import search_documents, with_documents
from ..operators.stats import COUNT_SECONDS, CountMemo, table_counts, within
from ..operators.summary import summary_stream


# What a client is told of a request that can't be read, and of a method that isn't taken.
INVALID, INVALID_METHOD = "Invalid request", "Invalid request method"


class BadRequest(ValueError):
    status = 400


class MethodNotAllowed(ValueError):
    status = 405


def _object(body: bytes | str) -> dict:
    try:
        found = json.loads(body)
    except ValueError as e:
        raise BadRequest(INVALID) from e
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise BadRequest(INVALID)
    return {str(k).lower(): v for k, v in found.items()}


def _text(values: dict, key: str) -> str:
    value = values.get(key)
    if value is not None and not isinstance(value, str):
        raise BadRequest(INVALID)
    return value or ""


def _count(values: dict, key: str) -> int:
    value = values.get(key)
    if value is None:
        return 0
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise BadRequest(INVALID)
    return value


@dataclass(frozen=True)
class SearchRequest:
    text: str
    count: int
    offset: int

    @classmethod
    def parse(cls, body: bytes | str) -> SearchRequest:
        """Keys match in any case; unknown ones are ignored; missing ones are empty or 0."""
        values = _object(body)
        return cls(_text(values, "text"), _count(values, "count"), _count(values, "offset"))


@dataclass(frozen=True)
class SummaryRequest:
    query: str
    id: int

    @classmethod
    def parse(cls, body: bytes | str) -> SummaryRequest:
        values = _object(body)
        return cls(_text(values, "query"), _count(values, "id"))


def parsed_requests(body: Column) -> Column:
    """Many search requests at once: a JSON column as struct<text, count, offset> by the rules of `SearchRequest.parse`, null where that refuses one."""
    values = F.try_variant_get(F.try_parse_json(body), "$", "map<string, variant>")

    def last(key: str) -> Column:
        return F.try_element_at(F.filter(F.map_entries(values), lambda e: F.lower(e["key"]) == key), F.lit(-1))["value"]

    def missing(value: Column) -> Column:
        return value.isNull() | F.is_variant_null(value)

    text, numbers = last("text"), {k: last(k) for k in ("count", "offset")}
    fine = missing(text) | (F.schema_of_variant(text) == "STRING")
    for value in numbers.values():
        fine &= missing(value) | ((F.schema_of_variant(value) == "BIGINT") & (F.try_variant_get(value, "$", "long") >= 0))
    count, offset = (F.coalesce(F.try_variant_get(v, "$", "long"), F.lit(0)).alias(k) for k, v in numbers.items())
    whole = F.struct(F.coalesce(F.try_variant_get(text, "$", "string"), F.lit("")).alias("text"), count, offset)
    # JSON null is an empty request.
    return F.when(values.isNotNull() & fine, whole).when(F.btrim(body) == "null", F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("offset")))


def answer_json(results: DataFrame) -> DataFrame:
    """All results as one row of JSON, ``{"documents": [...]}``; for a page of results, which the count bounds."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("document_similarity")).alias("o"), "document_id", F.struct(*results.columns).alias("r"))))
    return results.agg(F.to_json(F.struct(F.transform(ordered, lambda x: x["r"]).alias("documents"))).alias("answer"))


def decoded_body(body: bytes, content_encoding: str = "") -> bytes:
    """A request's body, decompressed if its header names zstd; what isn't zstd then is a bad request."""
    if "zstd" not in content_encoding:
        return body
    import zstandard

    try:
        return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    except zstandard.ZstdError as e:
        raise BadRequest(INVALID) from e


def encoded_answer(answer: bytes, accept_encoding: str = "") -> tuple[bytes, str]:
    """(body, content encoding): an answer compressed if the client's header names zstd."""
    if "zstd" not in accept_encoding:
        return answer, ""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(answer), "zstd"


class SearchService:
    """Search, counts and summaries over three tables of one tenant."""

    def __init__(self, documents: DataFrame, embeddings: DataFrame, centroids: DataFrame, embedder: Embedder, chat: Callable[[str], Iterable[str]] | None = None, owner: str = "wikipedia", category: str = "wikipedia", n_probe: int | None = None, counts: Callable[[], dict[str, int]] | None = None, cells: Cells | None = None):
        """Embeddings that have the tenant's columns are filtered by them, which prunes partitions; others are joined with the tenant's documents.

        With ``n_probe`` a search reads the embeddings of so many centroids (they then have a ``centroid_id``); without it all are compared.
        With ``cells`` a search reads what can matter alone and finds what comparing all does.  ``counts`` counts the tables in another way than by scanning them, such as `stored_counts` of two stores.
        """
        tenant = (F.col("owner") == owner) & (F.col("category") == category)
        self.documents, self.embedder, self.chat, self.centroids, self.n_probe, self.cells = documents.where(tenant), embedder, chat, centroids, n_probe, cells
        own = {"owner", "category"} <= set(embeddings.columns)
        self.embeddings = embeddings.where(tenant) if own else embeddings.join(self.documents.select("document_id"), "document_id", "left_semi")
        spark = documents.sparkSession
        self.counts = CountMemo(lambda: within(spark, COUNT_SECONDS, counts or (lambda: table_counts(embeddings, documents, centroids).first().asDict())))

    def search(self, request: SearchRequest) -> DataFrame:
        vector = self.embedder([request.text])[0]
        if self.cells is not None and self.n_probe is None:
            return with_documents(bounded_documents(self.embeddings, self.cells, vector, request.count, request.offset)[0], self.documents)
        rows = self.embeddings if self.n_probe is None else probed(self.embeddings, self.centroids, vector, self.n_probe)
        return with_documents(search_documents(rows, vector, request.count, request.offset), self.documents)

    @contextmanager
    def importing(self) -> Iterator[None]:
        """While an import runs no counts are kept; when it has ended they are, from the next one on."""
        self.counts.disable()
        try:
            yield
        finally:
            self.counts.enable()

    def summary(self, request: SummaryRequest) -> Iterator[str]:
        if self.chat is None:
            raise RuntimeError("no chat model")
        return summary_stream(self.documents, request.query, request.id, self.chat)

    def handle(self, path: str, method: str, body: bytes | str = b"") -> tuple[int, object]:
        """(status, answer): an object for JSON, an iterator of characters for a summary."""
        try:
            if method not in ("GET", "POST"):
                raise MethodNotAllowed(INVALID_METHOD)
            if path == "/api/search":
                rows = self.search(SearchRequest.parse(body)).collect()
                return 200, {"documents": [r.asDict() for r in sorted(rows, key=lambda r: (-r["document_similarity"], r["document_id"]))]}
            if path == "/api/count":
                return 200, self.counts.get()
            if path == "/api/ai":
                return 200, self.summary(SummaryRequest.parse(body))
            return 404, {"error": "Not found"}
        except (BadRequest, MethodNotAllowed) as e:
            return e.status, {"error": str(e)}
        except (CancelledError, TimeoutError):
            return 499, {"error": "Request canceled"}
        except Exception:
            return 500, {"error": "Request failed"}


    def handle_bytes(self, path: str, method: str, body: bytes = b"", content_encoding: str = "", accept_encoding: str = "") -> tuple[int, bytes, str]:
        """(status, body, content encoding) of `handle`, with bodies as they go over a wire; a summary is one body."""
        try:
            status, answer = self.handle(path, method, decoded_body(body, content_encoding))
        except BadRequest as e:
            status, answer = e.status, {"error": str(e)}
        raw = json.dumps(answer, ensure_ascii=False) if isinstance(answer, dict) else "".join(answer)
        return status, *encoded_answer(raw.encode(), accept_encoding)


class Client:
    """What the web client asks of the service."""

    def __init__(self, service: SearchService):
        self._service, self._summaries = service, {}

    def search(self, text: str, count: int = 20, offset: int = 0) -> list[dict]:
        status, answer = self._service.handle("/api/search", "POST", json.dumps({"text": text, "count": count, "offset": offset}))
        if status != 200:
            raise RuntimeError(f"search failed: {status}")
        return answer["documents"] or []

    def counts(self) -> dict[str, int]:
        status, answer = self._service.handle("/api/count", "GET")
        return answer if status == 200 else {"embeddings": 0, "documents": 0, "centroids": 0}

    def summary(self, query: str, document_id: int, on_text: Callable[[str], None] = lambda _: None) -> str:
        """The summary so far goes to ``on_text`` as it grows; a finished one is kept for the same query and document."""
        if (query, document_id) not in self._summaries:
            status, answer = self._service.handle("/api/ai", "POST", json.dumps({"query": query, "id": document_id}))
            if status != 200:
                raise RuntimeError(f"summary failed: {status}")
            text = ""
            for character in answer:
                text += character
                on_text(text)
            self._summaries[query, document_id] = text
        return self._summaries[query, document_id]
