"""Text functions of the importer as Column expressions; they stay inside the JVM and need no UDF."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as titles, lines and texts are trimmed of it.
WHITE_SPACE = "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Title prefixes, in lower case, of pages that aren't articles.
NAMESPACE_PREFIXES = [
    "file:", "file talk:", "category:", "category talk:", "user:", "talk:", "user talk:", "wikipedia:", "wikipedia talk:",
    "help:", "help talk:", "module:", "module talk:", "mediawiki:", "mediawiki talk:", "draft:", "draft talk:", "book:",
    "book talk:", "timedtext:", "timedtext talk:", "template:", "template talk:", "portal:", "portal talk:", "special:", "media:",
]

# What marks a disambiguation page, in lower case.
DISAMBIGUATION_MARKS = ["[[category:disambiguation", "{{disambiguation", "{{disambig"]

# Markers and patterns that cleaning deletes, in this order.
MARKERS = ["[[", "]]", "{{", "}}", "<ref>", "</ref>"]
URL = r"http[s]?://[^\t\n\f\r ]+"
WIKI_TABLE = r"(?s)\{\|.*?\|\}"
HTML_TABLE = r"(?s)<table.*?>.*?</table>"
#: The same where a ``>`` and a closing tag follow: the first ``>`` will do.
HTML_TABLE_FIRST = r"(?s)<table[^>]*+>.*?</table>"
ENTITY = r"&[a-zA-Z0-9#]+;"

# Fixed value: what article links start with.
ARTICLE_PREFIX = "https://en.wikipedia.org/wiki/"

# Fixed value: what a summary asks for.
SUMMARY_REQUEST = "Produce a one paragraph summary on the information and do not ask any followup questions"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_markers(text: Column) -> Column:
    """Delete brackets, braces and bare reference tags one kind after the other; what a deletion joins isn't looked at again for that kind."""
    return reduce(lambda t, mark: F.replace(t, F.lit(mark), F.lit("")), MARKERS, text)


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def _before_last(text: Column, mark: str) -> tuple[Column, Column]:
    """(what stands before the last ``mark``, what stands after it); without one all stands after it."""
    after = F.substring_index(text, mark, -1)
    return F.left(text, F.greatest(F.length(text) - F.length(after) - F.lit(len(mark)), F.lit(0))), after


def _bound(text: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of a text that it uses more than once: the one-element array binds it, so what it is made of stands in the plan once."""
    return F.transform(F.array(text), step)[0]


def strip_wiki_tables(text: Column) -> Column:
    """Delete what `WIKI_TABLE` matches.

    Only what ends with the last closing mark is searched: there every opening one has a match, so the time is linear however many are never closed.
    """
    def cut(t: Column) -> Column:
        head, tail = _before_last(t, "|}")
        return F.when(t.contains("|}"), F.concat(F.regexp_replace(F.concat(head, F.lit("|}")), WIKI_TABLE, ""), tail)).otherwise(t)

    return _bound(text, cut)


def strip_html_tables(text: Column) -> Column:
    """Delete what `HTML_TABLE` matches, in linear time.

    A match needs a ``>`` before the last closing tag.  Opening tags after the last such ``>`` can't begin one: they are masked by a
    character that no XML has, and every opening tag before it has a match.
    """
    def cut(t: Column) -> Column:
        body, tail = _before_last(t, "</table>")
        front, rest = _before_last(body, ">")
        masked = F.concat(front, F.lit(">"), F.replace(rest, F.lit("<table"), F.lit("<\0table")), F.lit("</table>"))
        found = F.replace(F.regexp_replace(masked, HTML_TABLE_FIRST, ""), F.lit("<\0table"), F.lit("<table"))
        return F.when(t.contains("</table>") & body.contains(">"), F.concat(found, tail)).otherwise(t)

    return _bound(text, cut)


def strip_entities(text: Column) -> Column:
    return F.regexp_replace(text, ENTITY, "")


def pipe_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))


def is_prose(line: Column) -> Column:
    """Whether a line stays: not blank, no file reference, no legend, at most one pipe unless it is a heading.

    The one-element array binds the trimmed line, which is then trimmed once; most lines have no pipe and stop there.
    """
    def keeps(x: Column) -> Column:
        piped = ~x.contains("|legend|") & ((pipe_count(x) <= 1) | x.startswith("=="))
        return (x != "") & ~F.lower(F.substring(x, 1, 5)).startswith("file:") & (~x.contains("|") | piped)

    return F.exists(F.array(trimmed(line)), keeps)


def filter_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), is_prose), "\n")


def clean_markup(text: Column) -> Column:
    """The importer's cleaning, step by step in its order."""
    steps = [strip_markers, strip_urls, strip_wiki_tables, strip_html_tables, strip_entities, filter_lines, trimmed]
    return reduce(lambda t, step: step(t), steps, text)


def is_namespaced(title: Column) -> Column:
    return F.lower(trimmed(title)).rlike("^(?:" + "|".join(NAMESPACE_PREFIXES) + ")")


def is_disambiguation(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(mark) for mark in DISAMBIGUATION_MARKS])


def article_url(name: Column) -> Column:
    """Spaces become underscores, then query escaping; Java's escaping differs in ``*`` and ``~``."""
    escaped = F.url_encode(F.replace(name, F.lit(" "), F.lit("_")))
    return F.concat(F.lit(ARTICLE_PREFIX), F.replace(F.replace(escaped, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


def score_percent(similarity: Column) -> Column:
    """A similarity from -1 to 1 as 0 to 100."""
    return 50.0 * (1.0 + similarity)


def score_label(similarity: Column) -> Column:
    return F.format_string("%.4f%%", score_percent(similarity))


def grouped_digits(count: Column) -> Column:
    return F.format_number(count, 0)


def summary_prompt(query: Column, document: Column) -> Column:
    return F.concat_ws("\n", query, F.lit(SUMMARY_REQUEST), document)
