"""Searches that read the cells that can matter, and documents without a shuffle, against comparing everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cells as X
from tessera.operators import centroids as C
from tessera.operators import search as S
from tessera.plans.service import SearchRequest, SearchService
from tessera.sources import store


def made(spark, kind, n=1500, dim=16, seed=7):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dim)) * (0 if kind == "random" else 4)
    rows = [(i, (middle[i % 12] + rng.normal(size=dim)).tolist()) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, [0.0] * dim), (n + 2, rows[3][1])], "vec_id long, embedding array<double>").cache()


def ranked(rows):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["similarity"], 9)) for r in rows)


@pytest.mark.parametrize("kind, most", [("random", 1.0), ("clustered", 0.35)])
def test_results_are_those_of_comparing_everything(spark, kind, most):
    rows = made(spark, kind)
    centroids = C.kmeans(rows.where("vec_id < 1500"), 24)
    assigned = C.assign(rows, centroids).cache()
    cells = X.read_cells(X.cell_radii(assigned, centroids), centroids)
    queries = rows.where("vec_id % 100 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = ranked(S.search_batch(rows, queries, 20).collect())
    found, read = X.bounded_batch(assigned, cells, queries, 20)
    assert ranked(found.collect()) == exact
    share = np.mean([r["cells"] for r in read.collect()]) / len(cells.ids)
    print(kind, "share of cells read", share)
    assert 0 < share <= most and read.count() == queries.count()
    for q in queries.limit(3).collect():
        for count, offset in ((20, 0), (5, 30), (0, 0), (3, 5000), (2000, 0)):
            page, n = X.bounded_search(assigned, cells, q["embedding"], count, offset)
            plain = S.search(rows, q["embedding"], count, offset, "vec_id").collect()
            assert [r["vec_id"] for r in page.collect()] == [r["vec_id"] for r in plain] and n <= len(cells.ids)


def test_rows_without_a_centroid_are_always_read(spark):
    rows = made(spark, "clustered", 300)
    centroids = C.kmeans(rows.where("vec_id < 300"), 6)
    assigned = C.assign(rows, centroids).withColumn("centroid_id", F.when(F.col("vec_id") % 10 != 0, F.col("centroid_id")))
    cells = X.read_cells(X.cell_radii(assigned, centroids), centroids)
    assert None in cells.ids
    vector = rows.where("vec_id = 40").first()["embedding"]
    assert [r[0] for r in X.bounded_search(assigned, cells, vector, 9)[0].collect()] == [r[0] for r in S.search(rows, vector, 9, key="vec_id").collect()]
    queries = rows.where("vec_id IN (40, 41)").select(F.col("vec_id").alias("query_id"), "embedding")
    assert ranked(X.bounded_batch(assigned, cells, queries, 9)[0].collect()) == ranked(S.search_batch(rows, queries, 9).collect())
    none = assigned.limit(0)
    assert X.bounded_search(none, X.read_cells(X.cell_radii(none, centroids), centroids), vector, 5)[0].collect() == []


def test_stored_cells_follow_appends_and_refreshes(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = made(spark, "clustered", 400).withColumnRenamed("vec_id", "document_id").select("document_id", F.col("embedding").cast("array<float>").alias("embedding"))
    store.append_embeddings(rows.where("document_id < 300"), path)
    C.refresh(spark, path, 8)
    store.append_embeddings(rows.where("document_id >= 300"), path)
    vector = [float(x) for x in rows.where("document_id = 350").first()["embedding"]]
    stored = store.read_embeddings(spark, path)
    cells = X.stored_cells(spark, path)
    assert int(cells.rows.sum()) == rows.count()
    found, read = X.bounded_documents(stored, cells, vector, 10)
    assert [r[0] for r in found.collect()] == [r[0] for r in S.search_documents(rows, vector, 10).collect()] and read < len(cells.ids)
    documents = rows.select("document_id", *[F.lit("x").alias(c) for c in ("owner", "category", "name", "external_id", "document")])
    service = SearchService(documents, stored, store.read_centroids(spark, path), lambda texts: np.array([vector]), owner="x", category="x", cells=cells)
    assert {r["document_id"] for r in service.search(SearchRequest("q", 10, 0)).collect()} == {r[0] for r in found.collect()}


def test_documents_of_many_embeddings_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(S, "ROUND_ROWS", 16)
    rng = np.random.default_rng(2)
    # One document has the 300 best embeddings.
    rows = [(1, [1.0, x]) for x in rng.uniform(0, 0.1, 300).tolist()] + [(int(d), [1.0, x]) for d, x in zip(rng.integers(2, 30, 400).tolist(), rng.uniform(0.2, 3, 400).tolist())] + [(99, [0.0, 0.0]), (98, None)]
    frame = spark.createDataFrame(rows, "document_id long, embedding array<double>")
    grouped = S.top(S.best_by_document(S.scored(frame, [1.0, 0.0])), 12, 0).collect()
    for count, offset in ((12, 0), (5, 7), (0, 3), (100, 0)):
        got = [tuple(r) for r in S.search_documents(frame, [1.0, 0.0], count, offset).collect()]
        want = [tuple(r) for r in S.top(S.best_by_document(S.scored(frame, [1.0, 0.0])), count, offset).collect()]
        assert got == want
    assert grouped[0]["document_id"] == 1
    plan = S.top(S.scored(frame, [1.0, 0.0]).select("document_id", "similarity"), 20)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
