"""Rows that share an id, or have none, in the pipeline's stages."""

from tessera.llm import decontaminate, near_copies

SCHEMA = "doc_id long, text string"
ITEM = "one two three four five six seven. eight nine ten eleven twelve."


def kept(rows):
    return sorted(map(str, map(tuple, rows.collect())))


def test_first_rows_by_id_and_text(spark):
    rows = [(5, "a b c d e"), (5, "x y z u v"), (3, "x y z u v"), (None, "p q r s"), (None, "k l m n o"), (None, "a b c d e"), (5, "a b c d e")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert kept(near_copies.keep_first(docs)) == sorted(map(str, [(5, "a b c d e"), (3, "x y z u v"), (None, "p q r s"), (None, "k l m n o")]))


def test_only_leaking_texts_go(spark):
    rows = [(None, ITEM), (None, "clean"), (None, None), (4, "before " + ITEM), (4, "clean too"), (6, "clean")]
    docs, items = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    clean = decontaminate.keep_clean(docs, items)
    assert clean.columns == docs.columns
    assert kept(clean) == sorted(map(str, [rows[1], rows[2], rows[4], rows[5]]))
