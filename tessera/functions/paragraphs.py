"""Paragraphs of a text, and the part of it that fits a budget, as Column expressions in linear time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a paragraph begins anew after.
LENGTH = 1000
#: What ends a sentence, and what is a token when tokens are counted.
SENTENCE_END = r"(?:[.!?][ \t\n]|\n)"
TOKEN = r"[^ \t\n\r\f]+"


def paragraphs(text: Column, length: int = LENGTH) -> Column:
    """array<struct<start, text>>: the k-th paragraph starts behind the first sentence that ends in the k-th ``length`` characters, or with them if none does.

    So a paragraph has at most twice ``length`` characters, and all of them together are the text.  ``start`` counts characters; null and empty texts have none.
    """
    windows = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s).{{1,{length}}}"), F.lit(0))
    head = lambda w: F.length(F.regexp_extract(w, f"(?s)^.*?{SENTENCE_END}", 0))
    cut = F.transform(windows, lambda w, i: F.struct(w.alias("w"), F.when(i == 0, 0).otherwise(head(w)).alias("h")))

    def joined(z: Column) -> Column:
        # What the next window has before its own first paragraph belongs to this one.
        more = lambda i: F.coalesce(F.left(F.get(z, i + 1)["w"], F.get(z, i + 1)["h"]), F.lit(""))
        return F.transform(z, lambda s, i: F.struct((i * length + s["h"]).cast("long").alias("start"), F.concat(F.substring(s["w"], s["h"] + 1, F.lit(length)), more(i)).alias("text")))

    bound = F.transform(F.array(cut), joined)[0]
    return F.filter(bound, lambda p: p["text"] != "")


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def within_budget(text: Column, budget: Column) -> Column:
    """The longest run of whole sentences from the start that has at most ``budget`` tokens; of a first sentence that is longer, its first tokens."""
    body = F.coalesce(text, F.lit(""))
    sentences = F.regexp_extract_all(body, F.lit(f"(?s).+?(?:{SENTENCE_END}|\\z)"), F.lit(0))
    start = F.struct(F.lit(0).alias("chars"), F.lit(0).cast("long").alias("tokens"))

    def add(so_far: Column, sentence: Column) -> Column:
        n = so_far["tokens"] + tokens(sentence)
        return F.struct(F.when(n <= budget, so_far["chars"] + F.length(sentence)).otherwise(so_far["chars"]).alias("chars"), n.cast("long").alias("tokens"))

    kept = F.left(body, F.aggregate(sentences, start, add)["chars"])
    first = F.array_join(F.slice(F.regexp_extract_all(F.get(sentences, F.lit(0)), F.lit(r"[ \t\n\r\f]*" + TOKEN), F.lit(0)), F.lit(1), F.greatest(budget, F.lit(0)).cast("int")), "")
    return F.when((kept != "") | (body == ""), kept).otherwise(F.coalesce(first, F.lit("")))
