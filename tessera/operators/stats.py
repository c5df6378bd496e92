"""Table counts in one row, and a shared memo of them."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Seconds that counting may take.
COUNT_SECONDS = 600
_T = TypeVar("_T")


def within(spark: SparkSession, seconds: float, action: Callable[[], _T]) -> _T:
    """The action's result; after ``seconds`` its jobs are cancelled, those that start later too, and TimeoutError is raised."""
    context, tag = spark.sparkContext, f"within-{uuid.uuid4().hex}"
    late, done = threading.Event(), threading.Event()

    def watch() -> None:
        wait = seconds
        while not done.wait(wait):
            late.set()
            context.cancelJobsWithTag(tag)
            wait = 0.5

    context.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"not done within {seconds} s") from e
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)


def table_counts(embeddings: DataFrame, documents: DataFrame, centroids: DataFrame) -> DataFrame:
    """(embeddings, documents, centroids): three counts, each from Parquet metadata where that serves."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(embeddings, "embeddings").crossJoin(one(documents, "documents")).crossJoin(one(centroids, "centroids"))


class CountMemo:
    """Counts that are asked for at the same time are made once, and kept while the memo is on."""

    def __init__(self, count: Callable[[], dict[str, int]]):
        self._count, self._lock, self._flight, self._kept, self._on = count, threading.Lock(), None, None, False

    def enable(self) -> None:
        with self._lock:
            self._on = True

    def disable(self) -> None:
        with self._lock:
            self._on, self._kept = False, None

    def get(self) -> dict[str, int]:
        with self._lock:
            if self._on and self._kept is not None:
                return dict(self._kept)
            flight, mine = self._flight, False
            if flight is None:
                flight = self._flight = {"done": threading.Event(), "value": None, "error": None}
                mine = True
        if mine:
            try:
                flight["value"] = self._count()
            except BaseException as e:
                flight["error"] = e
            finally:
                with self._lock:
                    self._flight = None
                    if self._on and flight["error"] is None:
                        self._kept = flight["value"]
                flight["done"].set()
        flight["done"].wait()
        if flight["error"] is not None:
            raise flight["error"]
        return dict(flight["value"])
