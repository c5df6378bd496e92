"""Stores under a log of commits: interruptions, writers at the same time, imports beside refreshes, counts, failing uploads."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import centroids as C
from tessera.operators import upload
from tessera.operators.embed import HashEmbedder, InTurn
from tessera.operators.importer import new_documents
from tessera.operators.search import search_documents
from tessera.operators.upload import import_pages
from tessera.plans.service import SearchService
from tessera.sources import store
from tessera.sources.commits import Conflict, Table

DOCS = "name string, external_id string, document string, owner string, category string"


def docs(spark, *names):
    return spark.createDataFrame([(n, "u", f"text of {n}", "wikipedia", "wikipedia") for n in names], DOCS)


def pages(spark, *titles):
    rows = [(t, f"text of {t}", i) for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "title string, text string, ingest_seq long").withColumn("redirect", F.lit(None).cast("string"))


def names(spark, path):
    return sorted(r["name"] for r in store.read_documents(spark, path).collect())


def vectors(spark, n, seed=3, first=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, 8)).astype(np.float32))], "document_id long, embedding array<float>")


def test_versions_are_put_once(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    assert table.snapshot().version == 0 and table.versions() == []
    with pytest.raises(FileNotFoundError):
        table.read()
    first = table.append(spark.range(5))
    part = table.write(spark.range(3))
    second = table.commit(first, [*first.parts, part])
    with pytest.raises(Conflict):
        table.commit(first, [])
    assert (second.version, second.rows, table.read().count()) == (2, 8, 8)
    assert table.read(table.snapshot(1)).count() == 5 and second.since(first) == (part,)
    # Rows of nothing make no version.
    assert table.append(spark.range(0)).version == 2


def test_an_interrupted_write_leaves_no_row(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "d")
    store.append_documents(docs(spark, "A"), path)
    bad = docs(spark, "B").withColumn("document", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        store.append_documents(bad, path)

    def die(*args, **kwargs):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Table, "commit", die)
        with pytest.raises(KeyboardInterrupt):
            store.append_documents(docs(spark, "C", "D"), path)
    assert names(spark, path) == ["A"]
    with monkeypatch.context() as m:
        m.setattr(Table, "_put", die)
        with pytest.raises(KeyboardInterrupt):
            store.append_documents(docs(spark, "E"), path)
    assert names(spark, path) == ["A"]
    store.append_documents(docs(spark, "C"), path)
    assert names(spark, path) == ["A", "C"] and store.stored_counts(spark, path, str(tmp_path / "none"))["documents"] == 2
    # What was left behind can be cleared; what counts stays.
    table = Table(spark, path)
    assert table.clear(hours=1) == 0 and table.clear(hours=-1) >= 2 and names(spark, path) == ["A", "C"]


def test_two_imports_at_once_add_a_name_once(spark, tmp_path):
    path = str(tmp_path / "d")
    before = Table(spark, path).snapshot()
    # Both have seen the empty store.
    store.append_documents(docs(spark, "A", "B"), path, before)
    store.append_documents(docs(spark, "B", "C"), path, before)
    assert names(spark, path) == ["A", "B", "C"]
    d, v, model = str(tmp_path / "d2"), str(tmp_path / "v2"), HashEmbedder(8)
    errors = []

    def run(*titles):
        try:
            import_pages(pages(spark, *titles), d, v, model)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=run, args=(f"T{k}", "shared", f"T{k + 1}")) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    assert names(spark, d) == ["T0", "T1", "T2", "T3", "T4", "shared"]
    assert sorted(r[0] for r in store.read_embeddings(spark, v).select("document_id").collect()) == sorted(r[0] for r in store.read_documents(spark, d).select("document_id").collect())


def test_import_refresh_import_search(spark, tmp_path):
    d, v, model = str(tmp_path / "d"), str(tmp_path / "v"), HashEmbedder(16)
    import_pages(pages(spark, "A", "B", "C", "A"), d, v, model)
    assert {r["centroid_id"] for r in store.read_embeddings(spark, v).collect()} == {None}
    assert C.refresh(spark, v, 2) == 2
    import_pages(pages(spark, "A", "B", "C", "D", "E"), d, v, model)
    import_pages(pages(spark, "A", "B", "C", "D", "E"), d, v, model)
    stored = store.read_embeddings(spark, v)
    assert Table(spark, v).snapshot().version == 3 and stored.count() == 5
    near = {r["document_id"]: r["centroid_id"] for r in C.assign(stored.drop("centroid_id"), store.read_centroids(spark, v)).collect()}
    assert {r["document_id"]: r["centroid_id"] for r in stored.collect()} == near
    documents = store.read_documents(spark, d)
    wanted = documents.where("name = 'D'").first()
    assert search_documents(stored, [float(x) for x in model([wanted["document"]])[0]], 1).first()["document_id"] == wanted["document_id"]
    assert store.stored_counts(spark, d, v) == {"documents": 5, "embeddings": 5, "centroids": 2}


def test_an_import_that_was_interrupted_between_its_writes(spark, tmp_path, monkeypatch):
    d, v, model = str(tmp_path / "d"), str(tmp_path / "v"), HashEmbedder(8)
    import_pages(pages(spark, "A"), d, v, model)
    with monkeypatch.context() as m:
        m.setattr(upload, "append_embeddings", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            import_pages(pages(spark, "A", "B"), d, v, model)
    assert names(spark, d) == ["A", "B"] and store.read_embeddings(spark, v).count() == 1
    import_pages(pages(spark, "A", "B", "C"), d, v, model)
    rows = store.read_documents(spark, d).join(store.read_embeddings(spark, v), "document_id").collect()
    assert sorted(r["name"] for r in rows) == ["A", "B", "C"]
    assert all(np.allclose(r["embedding"], model([r["document"]])[0]) for r in rows)


def test_refresh_swaps_a_whole_version(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "v"), vectors(spark, 120)
    first = C.kmeans(rows, 3)
    assert store.write_version(C.assign(rows, first, "document_id"), first, path) == 1
    monkeypatch_commit = Table.commit
    with monkeypatch.context() as m:
        m.setattr(Table, "commit", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            C.refresh(spark, path, 5, seed=2)
    assert Table.commit is monkeypatch_commit
    # The refresh that was interrupted left nothing, and the next one holds every row once.
    assert store.read_centroids(spark, path).count() == 3 and store.read_embeddings(spark, path).count() == 120
    assert C.refresh(spark, path, 5, seed=2) == 2
    assert store.read_centroids(spark, path).count() == 5 and store.read_embeddings(spark, path).count() == 120
    near = {r["document_id"]: r["centroid_id"] for r in C.assign(rows, store.read_centroids(spark, path), "document_id").collect()}
    assert {r["document_id"]: r["centroid_id"] for r in store.read_embeddings(spark, path).collect()} == near


def test_rows_that_arrive_during_a_refresh_stay(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "v"), vectors(spark, 60)
    store.append_embeddings(rows, path)
    kmeans = C.kmeans

    def slow(*args, **kwargs):
        found = kmeans(*args, **kwargs)
        store.append_embeddings(vectors(spark, 7, 4, 1000), path)
        return found

    monkeypatch.setattr(C, "kmeans", slow)
    C.refresh(spark, path, 4)
    got = store.read_embeddings(spark, path)
    near = {r["document_id"]: r["centroid_id"] for r in C.assign(got.drop("centroid_id"), store.read_centroids(spark, path), "document_id").collect()}
    assert got.count() == 67 and {r["document_id"]: r["centroid_id"] for r in got.collect()} == near
    # And an import that began before a refresh ended is assigned to the new centroids.
    base = Table(spark, path).snapshot()
    C.refresh(spark, path, 3)
    monkeypatch.undo()
    store.append_embeddings(vectors(spark, 5, 5, 2000), path, base=base, unless_stored=True)
    late = store.read_embeddings(spark, path)
    near = {r["document_id"]: r["centroid_id"] for r in C.assign(late.drop("centroid_id"), store.read_centroids(spark, path), "document_id").collect()}
    assert late.count() >= 72 and {r["document_id"]: r["centroid_id"] for r in late.collect()} == near


def test_counts_come_from_the_log(spark, tmp_path):
    d, v, model = str(tmp_path / "d"), str(tmp_path / "v"), HashEmbedder(8)
    import_pages(pages(spark, "A", "B"), d, v, model)
    C.refresh(spark, v, 2)
    service = SearchService(store.read_documents(spark, d), store.read_embeddings(spark, v), store.read_centroids(spark, v), model, counts=lambda: store.stored_counts(spark, d, v))
    import_pages(pages(spark, "C"), d, v, model, service=service)
    spark.sparkContext.setJobGroup("counting", "")
    assert service.handle("/api/count", "GET") == (200, {"embeddings": 3, "documents": 3, "centroids": 2})
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("counting")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_failing_uploads_are_reported_and_tried_again(spark, tmp_path):
    d, v, f = (str(tmp_path / x) for x in "dvf")
    plain = HashEmbedder(8)

    def model(texts):
        if any("B" in t for t in texts):
            raise RuntimeError("no")
        return plain(texts)

    import_pages(pages(spark, "A", "B", "C"), d, v, model, failed=f, attempts=2, parallel=2)
    by_id = {r["document_id"]: r["name"] for r in store.read_documents(spark, d).collect()}
    assert sorted(by_id[r["document_id"]] for r in store.read_embeddings(spark, v).collect()) == ["A", "C"]
    assert [(by_id[r["document_id"]], r["error"]) for r in store.read_rows(spark, f).collect()] == [("B", "RuntimeError: no")]
    import_pages(pages(spark, "A", "B", "C", "D"), d, v, plain, failed=f)
    assert store.read_rows(spark, f).count() == 0 and store.read_embeddings(spark, v).count() == 4


def test_models_in_turn():
    called = []

    def one(name, fails=False):
        def run(texts):
            called.append(name)
            if fails:
                raise RuntimeError(name)
            return np.ones((len(texts), 2))

        return run

    both = InTurn([one("a"), one("b")])
    both(["x"]), both(["x"]), both(["x"])
    assert called == ["a", "b", "a"]
    called.clear()
    assert InTurn([one("c", True), one("d")])(["x"]).shape == (1, 2) and called == ["c", "d"]
    with pytest.raises(RuntimeError):
        InTurn([one("e", True)])(["x"])


def test_relational_tables_in_pieces(spark, tmp_path):
    """Against a database that is there: Derby comes with Spark."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    store.append_jdbc(spark.range(100).select("id", (F.col("id") * 2).alias("twice")), url, "numbers")
    store.append_jdbc(spark.range(100, 110).select("id", (F.col("id") * 2).alias("twice")), url, "numbers")
    rows = store.read_jdbc(spark, url, "numbers", column="id", bounds=(0, 110), pieces=4)
    assert rows.rdd.getNumPartitions() == 4
    assert sorted(tuple(r) for r in rows.collect()) == [(i, 2 * i) for i in range(110)]
    pruned = store.read_jdbc(spark, url, "numbers").where("id > 105")
    assert pruned.count() == 4
    store.append_documents(new_documents(pages(spark, "A")), str(tmp_path / "d"))
    assert names(spark, str(tmp_path / "d")) == ["A"]
