"""Cleaning, titles and links on single strings."""

import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T

CLEANED = [
    ("[[Foo|bar]] and [[Baz]]", "Foo|bar and Baz"),
    ("[[A|a]] x [[B|b]]\nkeep", "keep"),
    ("== H | a | b ==\nx", "== H | a | b ==\nx"),
    ("{{Infobox|a=1|b=2}}\ntext", "text"),
    ("{| class=x\n|-\n| a || b\n|}\nafter", "after"),
    ("{| a {| b |} c |} d", "c |} d"),
    ("<table><tr><td>x</table>y", "y"),
    ("http://x.y/z</table> q", "q"),
    ("see [https://a.b/c label] &ndash;&#160;&amp;amp;", "see [ label] amp;"),
    ("<ref>abc</ref><ref name=x>d</ref>", "abc<ref name=x>d"),
    ("[[File:x.jpg|thumb|cap]]\n  file:foo\nok", "ok"),
    ("|legend|\nz", "z"),
    ("  a  \r\nb\r\n\r\n", "a  \r\nb"),
    ("{{{| t |}}} rest", "rest"),
    ("#REDIRECT [[Foo]]", "#REDIRECT Foo"),
    ("a\vhttp://x\vb c", "a\v c"),
    ("   \n\t\n", ""),
    ("FILE: x\n|one pipe\n||two", "|one pipe"),
    ("{{[[x]]}}{{{{y}}}}", "xy"),
    ("[[[[", ""),
    ("[<ref>[a]</ref>]", "[[a]]"),
    ("İfile: a\nX", "İfile: a\nX"),
    ("{|\n|-\n|legend|\n", "{|\n|-"),
    ("&a;b&b c;", "b&b c;"),
    ("", ""),
    (None, None),
]
TITLES = [
    ("Foo", True), ("FILE: x", False), ("User talk:A", False), ("TimedText:a", False), ("Talk:Foo", False), ("Talking Heads", True),
    ("Special talk:x", True), ("Media talk:x", True), ("Gadget:x", True), ("Book: A Novel", False), ("  Category:x", False), ("foo", True),
]
PAGES = [
    ("x [[Category:Disambiguation pages]]", True), ("{{Disambiguation}}", True), ("{{disambig-cleanup}}", True), ("{{DISAMBIG}}", True),
    ("{{Dab}}", False), ("{{ disambig }}", False), ("disambiguation", False),
]
LINKS = [("Foo Bar", "Foo_Bar"), ("a~b*c_e/é:+&()!@", "a~b%2Ac_e%2F%C3%A9%3A%2B%26%28%29%21%40"), ("100%7E", "100%257E")]


def apply(spark, values, function):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", function(F.col("x")).alias("y"))
    return [r["y"] for r in rows.orderBy("i").collect()]


def test_cleaning(spark):
    assert apply(spark, [a for a, _ in CLEANED], T.clean_markup) == [b for _, b in CLEANED]


def test_titles(spark):
    assert apply(spark, [a for a, _ in TITLES], lambda x: ~T.is_namespaced(x)) == [b for _, b in TITLES]
    assert len(T.NAMESPACE_PREFIXES) == 27


def test_disambiguation(spark):
    assert apply(spark, [a for a, _ in PAGES], T.is_disambiguation) == [b for _, b in PAGES]


def test_links(spark):
    assert apply(spark, [a for a, _ in LINKS], T.article_url) == [T.ARTICLE_PREFIX + b for _, b in LINKS]


def test_trim_takes_all_unicode_white_space(spark):
    assert apply(spark, [T.WHITE_SPACE + "a b" + T.WHITE_SPACE, T.WHITE_SPACE], T.trimmed) == ["a b", ""]
    assert len(T.WHITE_SPACE) == 25


def test_score_labels(spark):
    rows = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (0.123456789,)], "s double")
    assert [r[0] for r in rows.select(T.score_label(F.col("s"))).collect()] == ["100.0000%", "50.0000%", "0.0000%", "56.1728%"]


@pytest.mark.parametrize("seed", range(1))
def test_cleaned_lines_are_never_blank(spark, seed):
    @settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(st.lists(st.text(alphabet="ab |{}[]<>&;\n\t=ref", max_size=60), min_size=1, max_size=30))
    def check(texts):
        for out in apply(spark, texts, T.clean_markup):
            assert out == out.strip(T.WHITE_SPACE)
            assert all(line.strip(T.WHITE_SPACE) for line in out.split("\n")) or out == ""

    check()


def test_tables_are_stripped_as_the_patterns_say(spark):
    rng = random.Random(1)
    parts = ["{|", "|}", "{|}", "|", "}", "{", " x", "\n", "<table", "<table>", "</table>", ">", "<", "<table a=1>", "é", "||", "|}}"]
    rows = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(5000)]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", T.strip_wiki_tables(F.col("t")), T.strip_html_tables(F.col("t"))).collect()
    for text, wiki, html in got:
        assert wiki == re.sub(T.WIKI_TABLE, "", text) and html == re.sub(T.HTML_TABLE, "", text), text


def test_tables_that_are_never_closed_take_linear_time(spark):
    texts = ["{|" * 500_000, "<table>" * 150_000, "<table " * 150_000 + "></table>", "<table " * 150_000 + "</table>", "{| x " * 200_000 + "|}" + "{|" * 200_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").cache()
    rows.count()
    began = time.time()
    rows.select(F.length(T.strip_wiki_tables(F.col("t"))), F.length(T.strip_html_tables(F.col("t")))).collect()
    assert time.time() - began < 10
    rows.unpersist()


def test_a_text_stands_in_the_plan_once(spark):
    """Steps that use their input several times bind it; an import cleans a text once."""
    from tessera.operators.importer import new_documents

    pages = spark.createDataFrame([("A", "see http://a/b {| x |} y", 1, None)], "title string, text string, ingest_seq long, redirect string")
    for rows in (pages.select(T.clean_markup(F.col("text")).alias("document")), new_documents(pages)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("http[s]") == 1
        assert [r["document"] for r in rows.collect()] == ["see   y"]
