"""Dumps, plain and compressed, into a store: one at a time, and as a stream."""

import bz2

import pytest

from tessera.operators.embed import HashEmbedder
from tessera.operators.importer import first_by_name, new_documents
from tessera.sources.dump import read_pages
from tessera.sources.store import append_documents, read_documents, read_embeddings
from tessera.streaming.incremental import start_import

DUMP = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/"><siteinfo><sitename>S</sitename></siteinfo>
<page><title>Multi</title><ns>0</ns><id>1</id><revision><id>1</id><text>old</text></revision><revision><id>2</id><text>new</text></revision></page>
<page><title>Trailing empty</title><ns>0</ns><id>2</id><revision><text>old</text></revision><revision><text/></revision></page>
<page><title>Trailing missing</title><ns>0</ns><id>3</id><revision><text>old</text></revision><revision><id>4</id></revision></page>
<page><title>Attributes</title><ns>0</ns><id>4</id><revision><text bytes="3" xml:space="preserve">t</text></revision></page>
<page><title>Deleted</title><ns>0</ns><id>5</id><revision><text deleted="deleted"/></revision></page>
<page><title>Redirect</title><ns>0</ns><id>6</id><redirect title="Foo"/><revision><text>#REDIRECT [[Foo]]</text></revision></page>
<page><title>Malformed</title><ns>0</ns><id>x3</id><revision><text>never</text></revision></page>
<page><title>Bad contributor</title><ns>0</ns><id>7</id><revision><contributor><id>z</id></contributor><text>never</text></revision></page>
<page><title>Twice</title><ns>0</ns><id>8</id><revision><text>first</text></revision></page>
<page><title>Twice</title><ns>0</ns><id>9</id><revision><text>second</text></revision></page>
<page><title>Ambiguous</title><ns>0</ns><id>10</id><revision><text>{{disambig}}</text></revision></page>
<page><title>Ambiguous</title><ns>0</ns><id>11</id><revision><text>the article</text></revision></page>
<page><title>Talk:Multi</title><ns>1</ns><id>12</id><revision><text>talk</text></revision></page>
<page><title>  Spaced *  </title><ns>0</ns><id>13</id><revision><text>s</text></revision></page>
<page><title> </title><ns>0</ns><id>14</id><revision><text>untitled</text></revision></page>
</mediawiki>"""
EXPECTED = {"Multi": "new", "Trailing missing": "old", "Attributes": "t", "Redirect": "#REDIRECT Foo", "Twice": "first", "Ambiguous": "the article", "Spaced *": "s"}


@pytest.fixture(params=["xml", "xml.bz2"])
def dump(request, tmp_path):
    path = tmp_path / f"dump.{request.param}"
    path.write_bytes(bz2.compress(DUMP.encode()) if request.param.endswith("bz2") else DUMP.encode())
    return str(path)


def test_import_and_again(spark, dump, tmp_path):
    store = str(tmp_path / "store")
    for expected in (len(EXPECTED), 0):
        found = new_documents(read_pages(spark, dump), read_documents(spark, store)).collect()
        assert len(found) == expected
        append_documents(new_documents(read_pages(spark, dump), read_documents(spark, store)), store)
    rows = read_documents(spark, store).collect()
    assert {r["name"]: r["document"] for r in rows} == EXPECTED
    assert {r["external_id"] for r in rows if r["name"] == "Spaced *"} == {"https://en.wikipedia.org/wiki/Spaced_%2A"}
    assert {(r["owner"], r["category"]) for r in rows} == {("wikipedia", "wikipedia")}
    assert len({r["document_id"] for r in rows}) == len(rows) and min(r["document_id"] for r in rows) >= 0


def test_redirects_can_be_dropped(spark, dump):
    assert "Redirect" not in {r["name"] for r in new_documents(read_pages(spark, dump), drop_redirects=True).collect()}


def test_stream_adds_what_is_new(spark, tmp_path):
    folder, store = tmp_path / "dumps", str(tmp_path / "store")
    folder.mkdir()
    (folder / "a.xml").write_text(DUMP)
    for _ in range(2):
        start_import(spark, str(folder), store, str(tmp_path / "checkpoint")).awaitTermination(120)
        assert {r["name"]: r["document"] for r in read_documents(spark, store).collect()} == EXPECTED
    (folder / "b.xml").write_text(DUMP.replace("Twice", "Other"))
    vectors = str(tmp_path / "vectors")
    start_import(spark, str(folder), store, str(tmp_path / "checkpoint"), embeddings=vectors, embedder=HashEmbedder(8)).awaitTermination(120)
    stored = read_documents(spark, store)
    assert {r["name"] for r in stored.collect()} == {*EXPECTED, "Other"}
    assert stored.join(read_embeddings(spark, vectors), "document_id").count() == len(EXPECTED) + 1


def test_repeated_sequence_numbers(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "name string, ingest_seq int")
    assert sorted(r["name"] for r in first_by_name(rows).collect()) == ["a", "b"]


def test_a_dump_that_ends_too_early(spark, tmp_path):
    """A file cut inside a compressed block fails the read, or is left at that place on request; other files are read whole."""
    (tmp_path / "a.xml.bz2").write_bytes(bz2.compress(DUMP.encode())[:-40])
    (tmp_path / "b.xml.bz2").write_bytes(bz2.compress(DUMP.replace("Multi", "Second").encode()))
    with pytest.raises(Exception, match="(?i)bz|stream|end|corrupt"):
        read_pages(spark, str(tmp_path)).collect()
    titles = [r["title"] for r in read_pages(spark, str(tmp_path), skip_corrupt_files=True).collect()]
    assert "Second" in titles and titles.count("Redirect") <= 2


def test_a_stream_takes_several_files_a_batch(spark, tmp_path):
    """Batches are as many as the files ask for, not as many as the files, and each reads the store once."""
    folder, store = tmp_path / "dumps", str(tmp_path / "store")
    folder.mkdir()
    for i in range(5):
        (folder / f"{i}.xml").write_text(DUMP.replace("Twice", f"Twice {i}"))
    query = start_import(spark, str(folder), store, str(tmp_path / "checkpoint"), files=3)
    query.awaitTermination(120)
    assert query.lastProgress["batchId"] == 1
    rows = read_documents(spark, store).collect()
    assert sorted(r["name"] for r in rows) == sorted({*EXPECTED, *[f"Twice {i}" for i in range(5)]} - {"Twice"})


def test_the_stream_query_is_one_batch(spark, tmp_path, monkeypatch):
    from tessera.plans import queries as Q

    text = "text " * 20
    for i in range(3):
        spark.createDataFrame([(3 * i + k, f"{text}{i} {k}") for k in range(3)], "doc_id long, text string").write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    started, real = [], Q.start_import
    monkeypatch.setattr(Q, "start_import", lambda *a, **b: started.append(real(*a, **b)) or started[-1])
    assert sorted(r["name"] for r in Q.stream_import(spark, str(tmp_path)).collect()) == ["Article 0", "Article 1", "Article 2"]
    assert started[0].lastProgress["batchId"] == 0
