"""The pipeline stage by stage against plain versions, and every query of the subpackage on the smallest tables."""

import random
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import decontaminate, mixing, quality
from tessera.llm._common import id_crc32
from tessera.llm.queries import ORACLE_SQL, QUERIES

from test_classifiers import labelled, spoiled
from test_near_copies import plain_kept
from test_scans import exhaustive

DATA = Path("/root/testdata/sf0.001")
#: The columns that each query's result has at least.
COLUMNS = {
    "op1": "doc_id size text_crc32 law shard slot grown_shard",
    "op2": "doc_id held_out lang_pred score",
    "op3": "doc_id start n_tokens ids_crc32",
    "op4": "doc_id item_id",
    "op5": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op6": "doc_id license",
    "op7": "doc_id fingerprint component_id",
    "op8": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op9": "doc_id held_out score predicted",
    "op10": "doc_id size source_size target taken",
    "op11": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op12": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op13": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with junk, copies, leaks, nulls and a repeated row, their labels and a benchmark."""
    rng = random.Random(8)
    items = [(i, t + ". " + u + ".") for i, (_, t, _), (_, u, _) in zip(range(8), labelled(8, 1, (20, 30)), labelled(8, 2, (4, 8)))]
    rows, marks = [], []
    for i, t, lang in labelled(420, 9):
        bad = rng.random() < 0.2
        t = spoiled(t, rng) if bad else t
        if not bad and i % 9 == 0 and rows:
            t = rows[rng.randrange(len(rows))][1]
        if i % 17 == 0:
            t = f"{t} {rng.choice(items)[1]}"
        rows.append((i, t, lang, rng.choice(["s1", "s1", "s2", "s3", None]), len(t or "")))
        if i % 3:
            marks.append((i, int(not bad), 0))
    rows += [(500, None, None, None, None), (501, "", "en", "s1", 0), (7, *rows[7][1:])]
    path = tmp_path_factory.mktemp("corpus")
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", marks, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path), items


def test_stages(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    inputs, results = [], []
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(docs.collect())
        out = stage(spark, docs, path)
        results.append(out.collect())
        docs = spark.createDataFrame(results[-1], out.schema)
        if len(results) < 5:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    start = spark.read.parquet(f"{path}/documents.parquet")
    model = quality.fit_quality(start, spark.read.parquet(f"{path}/labels.parquet"), id_crc32("doc_id") % 4 != 2)
    scores = model.score([r["text"] or "" for r in inputs[0]])
    assert Counter(r["doc_id"] for r in results[0]) == Counter(r["doc_id"] for r, s in zip(inputs[0], scores) if s >= 0.7)

    assert sorted((r["doc_id"], r["text"]) for r in results[1]) == sorted(plain_kept((r["doc_id"], r["text"]) for r in inputs[1]))
    assert 0 < len(results[1]) < len(inputs[1])

    assert sorted(r["doc_id"] for r in results[2]) == sorted(r["doc_id"] for r in inputs[2] if not exhaustive(items, r["text"]))
    assert 0 < len(results[2]) < len(inputs[2])

    plan = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(inputs[3], start.schema)).collect()}
    times = Counter(r["doc_id"] for r in results[3])
    for i, r in plan.items():
        if r["size"]:
            whole, part = divmod(r["taken"], r["size"])
            assert times[i] == whole + (part > 0 and 2 * part >= r["size"])

    assert Counter((r["doc_id"], r["text_crc32"]) for r in results[4]) == Counter((r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in inputs[4])
    assert Counter(map(tuple, corpus_pipeline.run(spark, path).collect())) == Counter(map(tuple, results[4]))


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(name.split("_")[0][2:]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, str(DATA))
    rows = df.collect()
    wanted = COLUMNS[name.split("_")[0]].split()
    assert df.columns[: len(wanted)] == wanted
    if name.split("_")[0] not in ("op4", "op6", "op12"):
        ids = [r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()]
        assert sorted(r["doc_id"] for r in rows) == sorted(ids)
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for of in ("documents", "conversations"):
            con.execute(f"CREATE VIEW {of} AS SELECT * FROM read_parquet('{DATA}/{of}.parquet')")
        found = con.execute(ORACLE_SQL[name])
        assert [c[0] for c in found.description] == df.columns
        assert sorted(map(tuple, rows)) == sorted(found.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_leaks_of_the_test_tables(spark):
    read = lambda name: [tuple(r) for r in spark.read.parquet(f"{DATA}/{name}.parquet").collect()]
    items = [r[:2] for r in read("benchmark")]
    expected = {(r[0], k) for r in read("documents") for k in exhaustive(items, r[1])}
    got = decontaminate.leaked_items(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == expected
