"""Search, centroids, counts, summaries, the service and its settings."""

import json
import stat
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.vector import cosine
from tessera.operators import centroids as C
from tessera.operators import search as S
from tessera.operators.embed import HashEmbedder, embed, embed_or_report
from tessera.operators.lsh import lsh_search
from tessera.operators.progress import observed
from tessera.operators.stats import CountMemo, within
from tessera.plans.service import BadRequest, Client, SearchRequest, SearchService, parsed_requests
from tessera.sources import store
from tessera.sources.config import Settings, load_settings, parse_settings


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)).astype(np.float32))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").cache()


def brute(vectors, query):
    rows = vectors.collect()
    m = np.array([r["embedding"] for r in rows], float)
    q = np.array(query, float)
    s = m @ q / np.linalg.norm(m, axis=1) / np.linalg.norm(q)
    return sorted(((r["vec_id"], x) for r, x in zip(rows, s)), key=lambda r: (-r[1], r[0]))


def test_exact_search_and_pages(vectors):
    query = vectors.where("vec_id = 7").first()["embedding"]
    expected = brute(vectors, query)
    assert [r["vec_id"] for r in S.search(vectors, query, 20, key="vec_id").collect()] == [i for i, _ in expected[:20]]
    assert [r["vec_id"] for r in S.search(vectors, query, 20, 20, "vec_id").collect()] == [i for i, _ in expected[20:40]]
    assert S.search(vectors, query, 0, key="vec_id").count() == 0
    assert S.search(vectors, query, 5, 1000, "vec_id").count() == 0
    with pytest.raises(ValueError):
        S.search(vectors, query, -1, key="vec_id")


def test_batch_search_equals_single(vectors, monkeypatch):
    monkeypatch.setattr(S, "QUERY_BLOCK", 2)
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = S.search_batch(vectors, queries, 7).collect()
    for q in queries.collect():
        own = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == q["query_id"])
        assert own == [(n + 1, i) for n, (i, _) in enumerate(brute(vectors, q["embedding"])[:7])]
    assert S.search_batch(vectors, queries.limit(0), 7).count() == 0
    assert S.search_batch(vectors.limit(0), queries, 7).count() == 0


def test_cosine_is_symmetric_and_bounded(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [tuple(r) for r in rows.select(cosine(F.col("a"), F.col("b")), cosine(F.col("b"), F.col("a"))).collect()]
    assert got[0] == pytest.approx((1, 1)) and got[1] == (-1, -1) and got[2] == (None, None) and got[3] == (None, None)


def test_probing_all_centroids_is_exact(vectors):
    centroids = C.kmeans(vectors, 5)
    assigned = C.assign(vectors, centroids)
    near = {r["vec_id"]: r["centroid_id"] for r in assigned.collect()}
    table = {r["centroid_id"]: np.array(r["centroid"]) for r in centroids.collect()}
    for r in vectors.limit(50).collect():
        v = np.array(r["embedding"])
        assert near[r["vec_id"]] == max(table, key=lambda c: (v @ table[c] / np.linalg.norm(table[c]), -c))
    query = vectors.where("vec_id = 9").first()["embedding"]
    exact = [r["vec_id"] for r in S.search(vectors, query, 20, key="vec_id").collect()]
    assert [r["vec_id"] for r in C.probed_search(assigned, centroids, query, n_probe=5).collect()] == exact
    assert len(C.probe(centroids, query, 2)) == 2


def test_top_k_keeps_no_sort_of_everything(vectors):
    plan = S.search(vectors, [1.0] * 8, 5, 2, "vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.fixture()
def service(spark):
    rows = [(i, "wikipedia", "wikipedia", f"N{i}", f"u{i}", text) for i, text in enumerate(["red apple pie", "green apple", "blue sky", "night sky stars"])]
    documents = spark.createDataFrame([*rows, (9, "other", "wikipedia", "X", "x", "blue sky")], "document_id long, owner string, category string, name string, external_id string, document string")
    embedder = HashEmbedder(32)
    return SearchService(documents, embed(documents, embedder), documents.limit(2), embedder, chat=lambda prompt: prompt.split(" "))


def test_service_search(service):
    status, answer = service.handle("/api/search", "POST", json.dumps({"TEXT": "blue sky", "count": 2, "more": 1}))
    assert status == 200 and [d["document_id"] for d in answer["documents"]] == [2, 3]
    assert answer["documents"][0]["document_similarity"] == pytest.approx(1)
    assert set(answer["documents"][0]) == {"name", "external_id", "document", "document_id", "document_similarity"}
    assert service.handle("/api/search", "POST", "{}") == (200, {"documents": []})


@pytest.mark.parametrize("body", ["", "x", '{"count": -1}', '{"count": "5"}', '{"text": 3}', "[]", '{"offset": 1.5}'])
def test_bad_requests(service, body):
    assert service.handle("/api/search", "POST", body)[0] == 400
    with pytest.raises(BadRequest):
        SearchRequest.parse(body)


def test_methods_and_failures(service):
    assert service.handle("/api/search", "PUT", "{}")[0] == 405
    service.embedder = lambda texts: (_ for _ in ()).throw(TimeoutError())
    assert service.handle("/api/search", "POST", "{}")[0] == 499
    service.embedder = lambda texts: 1 / 0
    assert service.handle("/api/search", "POST", "{}")[0] == 500


def test_counts_and_client(service):
    client = Client(service)
    assert client.counts() == {"embeddings": 5, "documents": 5, "centroids": 2}
    assert [d["name"] for d in client.search("apple", 1)] == ["N1"]
    seen = []
    text = client.summary("what", 2, seen.append)
    assert text.startswith("what\nProduce") and text.endswith("bluesky") and seen[-1] == text
    assert client.summary("what", 2) == text


def test_summary_of_a_missing_document(service):
    status, stream = service.handle("/api/ai", "POST", '{"query": "q", "id": 77}')
    with pytest.raises(LookupError):
        list(stream)


def test_count_memo_shares_one_flight():
    calls = []

    def count():
        calls.append(1)
        time.sleep(0.2)
        return {"n": len(calls)}

    memo = CountMemo(count)
    got = []
    threads = [threading.Thread(target=lambda: got.append(memo.get())) for _ in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == [{"n": 1}] * 5
    memo.enable()
    assert memo.get() == {"n": 2} and memo.get() == {"n": 2}
    memo.disable()
    assert memo.get() == {"n": 3}


def test_settings(tmp_path):
    path = tmp_path / "settings.json"
    assert load_settings(str(path)) == Settings()
    assert stat.S_IMODE(path.stat().st_mode) == 0o600
    made = parse_settings('{"AI": {"embed": {"url": ["a", "b"]}}, "unknown": 1}')
    assert made.upload_parallelism == 20 and made.storage == Settings().storage


def test_failing_texts_are_reported(spark):
    documents = spark.createDataFrame([(i, "bad" if i == 3 else f"text {i}") for i in range(10)], "document_id long, document string")

    def model(texts):
        if "bad" in texts:
            raise ValueError("no vector")
        return HashEmbedder(4)(texts)

    got = {r["document_id"]: r for r in embed_or_report(documents, model, batch=4, parallel=2).collect()}
    assert len(got) == 10 and got[3]["error"] == "ValueError: no vector" and got[3]["embedding"] is None
    assert all(r["error"] is None and len(r["embedding"]) == 4 for i, r in got.items() if i != 3)


def test_observed_rows(spark):
    rows, seen = observed(spark.createDataFrame([("ab",), (None,), ("c",)], "document string"))
    rows.collect()
    assert seen.get == {"rows": 3, "characters": 3}


def test_jobs_end_in_time(spark):
    assert within(spark, 60, lambda: spark.range(5).count()) == 5
    with pytest.raises(TimeoutError):
        within(spark, 1, lambda: spark.range(10**13).selectExpr("sum(hash(id) % 7)").collect())
    with pytest.raises(ZeroDivisionError):
        within(spark, 60, lambda: 1 / 0)


def test_a_document_is_found_once(spark):
    """Three vectors of document 1 are nearer than any of document 2; a page has each document once, by its nearest vector."""
    documents = spark.createDataFrame([(i, "wikipedia", "wikipedia", f"N{i}", "u", "t") for i in (1, 2, 3)], "document_id long, owner string, category string, name string, external_id string, document string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.2]), (2, [1.0, 0.5]), (3, [0.0, 1.0]), (3, [1.0, 0.3])], "document_id long, embedding array<double>")
    service = SearchService(documents, vectors, documents.limit(0), lambda texts: np.array([[1.0, 0.0]]))
    status, answer = service.handle("/api/search", "POST", '{"text": "x", "count": 3}')
    assert status == 200 and [d["document_id"] for d in answer["documents"]] == [1, 3, 2]
    assert answer["documents"][1]["document_similarity"] == pytest.approx(1 / np.hypot(1, 0.3))


def test_a_service_that_probes_reads_its_tenant_and_centroids_alone(spark, tmp_path):
    documents = spark.createDataFrame([(i, "o" if i < 40 else "p", "c", f"N{i}", "u", "t") for i in range(80)], "document_id long, owner string, category string, name string, external_id string, document string")
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, "o" if i < 40 else "p", "c", rng.normal(size=4).tolist()) for i in range(80)], "document_id long, owner string, category string, embedding array<double>")
    centroids = C.kmeans(rows, 6)
    store.append_embeddings(C.assign(rows, centroids, "document_id"), str(tmp_path / "e"))
    stored = store.read_embeddings(spark, str(tmp_path / "e"))
    vector = [1.0, 0.0, 0.0, 0.0]
    service = SearchService(documents, stored, centroids, lambda texts: np.array([vector]), owner="o", category="c", n_probe=2)
    found = service.search(SearchRequest("x", 100, 0)).collect()
    near = C.probe(centroids, vector, 2)
    assert sorted(r["document_id"] for r in found) == sorted(r["document_id"] for r in stored.where(F.col("centroid_id").isin(near) & (F.col("owner") == "o")).collect())
    read = C.probed(service.embeddings, centroids, vector, 2).select("document_id", F.input_file_name().alias("f")).collect()
    scan = C.probed(service.embeddings, centroids, vector, 2)._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    folders = sorted({tuple(r["f"].split("/")[-4:-1]) for r in read})
    assert folders and all(o == "owner=o" and c == "category=c" and int(n.split("=")[1]) in near for o, c, n in folders)
    # The scan itself leaves the other folders out.
    assert scan.selectedPartitions().filePartitionIterator().size() == len(folders)


def _recall(found, exact):
    return len({(r["query_id"], r["vec_id"]) for r in found} & {(r["query_id"], r["vec_id"]) for r in exact}) / len(exact)


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_recall_of_probes_and_projections(spark, kind):
    """Against the exact way, at the defaults: vectors without any clusters are the hardest case."""
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(12, 16)) * (0 if kind == "random" else 3)
    table = [(i, (middle[i % 12] + rng.normal(size=16)).tolist()) for i in range(1500)]
    rows = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = S.search_batch(rows, queries, 20).collect()
    centroids = C.kmeans(rows, 12)
    assigned = C.assign(rows, centroids)
    assert _recall(C.probed_batch(assigned, centroids, queries).collect(), exact) >= 0.9
    assert _recall(C.probed_batch(assigned, centroids, queries, n_probe=12).collect(), exact) == 1
    hits = []
    for q in queries.limit(5).collect():
        found = {r["vec_id"] for r in lsh_search(rows, [3 * x for x in q["embedding"]]).collect()}
        hits.append(len(found & {r["vec_id"] for r in exact if r["query_id"] == q["query_id"]}) / 20)
    assert np.mean(hits) >= 0.9


def test_probed_batch_equals_probed_search(vectors):
    centroids = C.kmeans(vectors, 5)
    assigned = C.assign(vectors, centroids)
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = C.probed_batch(assigned, centroids, queries, 7, 2).collect()
    for q in queries.collect():
        own = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q["query_id"]]
        assert own == [r["vec_id"] for r in C.probed_search(assigned, centroids, q["embedding"], 7, n_probe=2).collect()]


def test_zstd_bodies(service):
    import zstandard

    body = zstandard.ZstdCompressor().compress(b'{"text": "blue sky", "count": 1}')
    status, raw, encoding = service.handle_bytes("/api/search", "POST", body, "zstd", "gzip, zstd")
    assert (status, encoding) == (200, "zstd") and [d["document_id"] for d in json.loads(zstandard.ZstdDecompressor().decompressobj().decompress(raw))["documents"]] == [2]
    assert service.handle_bytes("/api/search", "POST", b"plain", "zstd")[0] == 400
    assert service.handle_bytes("/api/count", "GET")[1:] == (b'{"embeddings": 5, "documents": 5, "centroids": 2}', "")


def test_a_model_that_hangs_is_left_behind(spark):
    def slow(texts):
        if "slow" in texts:
            time.sleep(20)
        return np.ones((len(texts), 2), np.float32)

    rows = spark.createDataFrame([(1, "a"), (2, "slow"), (3, "b")], "document_id long, document string").coalesce(1)
    began = time.time()
    got = {r["document_id"]: r["error"] for r in embed_or_report(rows, slow, attempts=1, seconds=0.5).collect()}
    assert got[1] is None and got[3] is None and "TimeoutError" in got[2] and time.time() - began < 19


def test_many_requests_are_parsed_like_one(spark):
    bodies = ["", "x", "{}", "null", "[]", "3", '{"count": -1}', '{"count": "5"}', '{"text": 3}', '{"offset": 1.5}', '{"TEXT": "a", "Count": 7, "more": [1]}', '{"text": null, "offset": 9}', '{"text": "é \\" ok", "count": 0, "offset": 12345678901}', '{"count": true}']
    got = {r["b"]: r["r"] for r in spark.createDataFrame([(b,) for b in bodies], "b string").select("b", parsed_requests(F.col("b")).alias("r")).collect()}
    for body in bodies:
        try:
            expected = SearchRequest.parse(body)
        except BadRequest:
            assert got[body] is None, body
        else:
            assert (got[body]["text"], got[body]["count"], got[body]["offset"]) == (expected.text, expected.count, expected.offset), body


def test_batch_search_in_tiles_with_ties(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = rng.integers(-1, 2, (300, 3)).astype(float)  # very many equal vectors
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(values)], "vec_id long, embedding array<double>").repartition(3)
    queries = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    monkeypatch.setattr(S, "TILE_ROWS", 16)
    found = {}
    for r in S.search_batch(rows, queries, 7).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r
    lengths = np.maximum(np.linalg.norm(values, axis=1), 1e-300)
    assert len(found) == 30
    for q, ranks in found.items():
        near = np.round((values @ values[q]) / lengths / lengths[q], 9)
        assert [round(ranks[i + 1]["similarity"], 9) for i in range(7)] == sorted(near.tolist(), reverse=True)[:7]
        assert len({r["vec_id"] for r in ranks.values()}) == 7


def test_batch_search_keeps_its_memory(spark):
    """What a task holds follows the tile, not the rows of an Arrow batch times the queries."""
    import resource

    import pyarrow as pa

    def most(rows):
        def run(batches):
            for _ in batches:
                pass
            yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss])], ["kb"])

        return max(r["kb"] for r in rows.mapInArrow(run, "kb long").collect()) // 1024

    rows = spark.range(0, 40_000, 1, 4).select(F.col("id").alias("vec_id"), F.array(*[F.xxhash64("id", F.lit(i)) / 1e18 for i in range(8)]).alias("embedding"))
    before = most(rows)
    assert S.search_batch(rows, rows.where("vec_id < 1000").withColumnRenamed("vec_id", "query_id"), 5).count() == 5000
    assert most(rows) - before < 200
