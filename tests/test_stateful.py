"""First pages of names by keyed state, with restarts in the middle."""

import time

import pytest

from tessera.operators.progress import StreamConsumed, consumed
from tessera.sources.dump import read_pages
from tessera.sources.commits import Table
from tessera.sources.store import append_documents, read_documents
from tessera.streaming import stateful
from tessera.streaming.incremental import start_import

PAGE = "<page><title>{}</title><ns>0</ns><id>{}</id><revision><text>{}</text></revision></page>"


def dump(folder, name, *pages):
    (folder / name).write_text("<mediawiki>" + "".join(PAGE.format(*p) for p in pages) + "</mediawiki>")


def held(spark, store):
    return {r["name"]: r["document"] for r in read_documents(spark, store).collect()}


def test_names_are_state(spark, tmp_path, monkeypatch):
    folder, store, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "progress")
    folder.mkdir()
    append_documents(spark.createDataFrame([("Old", "u", "stored", "wikipedia", "wikipedia"), ("A", "u", "another's", "x", "y")], "name string, external_id string, document string, owner string, category string"), store)
    dump(folder, "1.xml", ("A", 2, "second"), ("A", 1, "first"), ("Old", 3, "again"), ("Talk:A", 4, "x"), ("B", 5, "b"))
    real, calls = stateful.append_batch, []

    def dies(batch, path, stream, number):
        real(batch, path, stream, number)
        calls.append(number)
        if len(calls) == 1:
            raise RuntimeError("lost after its commit")

    monkeypatch.setattr(stateful, "append_batch", dies)
    run = lambda: stateful.start_stateful_import(spark, str(folder), store, checkpoint).awaitTermination(180)
    with pytest.raises(Exception, match="lost after its commit"):
        run()
    dump(folder, "2.xml", ("B", 6, "later"), ("C", 7, "c"))
    first = read_documents(spark, store).where("owner = 'wikipedia'").count()
    run()
    mine = {r["name"]: r["document"] for r in read_documents(spark, store).where("owner = 'wikipedia'").collect()}
    assert mine == {"Old": "stored", "A": "first", "B": "b", "C": "c"} and calls[:2] == [0, 0] and first == 3
    assert read_documents(spark, store).count() == 5
    assert stateful.last_batch(spark, store, checkpoint) >= 1
    # What comes later, to the same state.
    dump(folder, "3.xml", ("C", 8, "late"), ("D", 9, "d"))
    run()
    assert {r["name"]: r["document"] for r in read_documents(spark, store).where("owner = 'wikipedia'").collect()} == mine | {"D": "d"}
    versions = Table(spark, store).versions()
    run()
    assert Table(spark, store).versions() == versions


def test_bytes_and_pages_consumed(spark, tmp_path):
    folder, store, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "progress")
    folder.mkdir()
    for i in range(4):
        dump(folder, f"{i}.xml", *[(f"T{i}x{k}", 10 * i + k, "text " * (k + 1)) for k in range(i + 2)])
    sizes = [f.stat().st_size for f in sorted(folder.iterdir())]
    listener = StreamConsumed(spark, checkpoint)
    spark.streams.addListener(listener)
    try:
        start_import(spark, str(folder), store, checkpoint).awaitTermination(180)
        until = time.time() + 20
        while len(listener.batches) < 4 and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert (listener.rows, listener.bytes) == (14, sum(sizes)) and sorted(listener.batches.values()) == sorted((i + 2, n) for i, n in enumerate(sizes))
    rows, seen, size = consumed(read_pages(spark, str(folder)))
    rows.write.format("noop").mode("overwrite").save()
    assert (seen.get["rows"], size) == (14, sum(sizes))


def test_a_name_costs_no_data_frame():
    """Rows of a name come as they are; the first is that of the lowest file and id, one without an id last."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    values = []
    seen = SimpleNamespace(exists=lambda: bool(values), update=values.append)
    first = stateful.FirstOfName()
    first.init(SimpleNamespace(getValueState=lambda *_: seen))
    rows = [Row(name="A", document=d, file=f, page_id=p) for d, f, p in (("x", "2", 1), ("none", "1", None), ("y", "1", 9), ("z", "1", 3))]
    assert list(first.handleInputRows(("A",), iter(rows), None)) == [Row(name="A", document="z")]
    assert list(first.handleInputRows(("A",), iter(rows), None)) == []
