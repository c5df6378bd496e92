"""Benchmark decontamination: a BM25 inverted index of test items, block-max WAND, and an exact check of wording.

The items are indexed; every passage of every training document is a query.  Passages are windows of two strides, a stride being
as long as the longest item, so an item lies whole in some passage wherever it stands.  A passage's score for an item is
BM25 over the passage's distinct words, divided by the score of the item for itself: 1 means that all its words are there.
All items of at least ``THRESHOLD`` are retrieved by block-max WAND.  Before that, one numpy step takes the bounds of all of
a document's passages in all blocks of postings: a passage in which no block can reach the threshold has no pivot, and only blocks that
can are opened.  Both are bounds, so nothing above the threshold is lost.

A retrieved item counts as leaked if its wording is in the passage: of the words of its question and of its answer (the last sentence), ``OVERLAP`` at
least stand there in the same order and about as close (``SLACK`` words), for each of both; a part may always lack one word of three or more.  So a
leak with a word changed is a leak.

The index is cut into blocks of items of ``SHARD_BYTES`` of text each, with the statistics of all items.  Each block is one broadcast; every batch of the
corpus meets all of them in one pass, and a worker holds at most ``HELD`` at a time.  Very long texts are searched in slabs of strides.  Words are in lower case (A-Z) between ASCII white space, without ASCII punctuation.

Null texts and texts without words leak nothing, and items without words can't leak.  Items of equal wording are all reported;
repeated rows give repeated results.  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import difflib
import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER_AZ, bounded_batches, staged

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
SLACK = 2
#: Items in a block of postings.
BLOCK = 4
#: Bytes of item texts in one broadcast index.
SHARD_BYTES = 2 << 20
#: Blocks of the index that a worker holds at most.
HELD = 16
STRIDE = 32
#: Bounds of (stride, block of postings) that are taken at a time, and bytes of text that are cut into words at a time.
SLAB_CELLS = 1 << 20
SLICE = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
PUNCTUATION = string.punctuation.encode()


def words_of(text: str | bytes) -> list[bytes]:
    return (text.encode("utf-8", "ignore") if isinstance(text, str) else text).translate(LOWER_AZ, PUNCTUATION).split()


def slabs(text: bytes, stride: int, strides: int) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first stride, words) of runs of at most ``strides`` strides; each begins with the last stride of the one before."""
    ahead, held, at = 0, [], 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE)
        to = gap.start() if gap else len(text)
        held += words_of(text[at:to])
        at = to
        while len(held) > strides * stride:
            yield ahead, held[: strides * stride]
            held, ahead = held[(strides - 1) * stride :], ahead + strides - 1
    if held:
        yield ahead, held


def aligned(part: list[bytes], words: list[bytes]) -> float:
    """The share of a part's words that stand in the passage in the part's order, around its longest common run and no further apart than in the part."""
    if not part:
        return 1.0
    run = difflib.SequenceMatcher(None, words, part, autojunk=False).find_longest_match()
    begin = run.a - run.b
    window = words[max(0, begin - SLACK) : begin + len(part) + SLACK] if run.size else []
    return sum(m.size for m in difflib.SequenceMatcher(None, window, part, autojunk=False).get_matching_blocks()) / len(part)


def enough(share: float, part: list[bytes], overlap: float) -> bool:
    """A part of three words or more may always lack one."""
    return share >= overlap or len(part) > 2 and round((1 - share) * len(part)) <= 1


def question_and_answer(text: str) -> tuple[str, str]:
    """Cut before the last sentence; a text of one sentence is all question."""
    body = text.strip()
    cuts = [i + 1 for i, c in enumerate(body[:-1]) if c in ".?!\n" and body[i + 1].isspace()]
    return (body[: cuts[-1]], body[cuts[-1] :]) if cuts else (body, "")


class Index:
    """Postings of items, sorted by item, with the largest weight of each block of ``BLOCK`` items."""

    def __init__(self, items: list[tuple[int, str]], statistics: tuple[dict[bytes, int], int, float, int] | None = None):
        """``statistics`` of all items, if these are only some: items by word, items, mean length, longest length."""
        kept = [(i, words_of(t), t) for i, t in items]
        kept = [x for x in kept if x[1]]
        self.ids = [x[0] for x in kept]
        self.parts = [tuple(words_of(p) for p in question_and_answer(x[2])) for x in kept]
        counts = [Counter(x[1]) for x in kept]
        df, n_items, mean, longest = statistics or (Counter(w for c in counts for w in c), len(kept), sum(c.total() for c in counts) / max(1, len(kept)), max((len(x[1]) for x in kept), default=1))
        self.stride = max(STRIDE, longest)
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for n, c in enumerate(counts):
            weight = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * c.total() / mean)) for w, tf in c.items()}
            whole = sum(weight.values())
            for w, x in weight.items():
                postings.setdefault(w, []).append((n, x / whole))
        self.terms = {w: k for k, w in enumerate(sorted(postings))}
        self.postings = [postings[w] for w in self.terms]
        self.blocks: list[list[tuple[int, float, int]]] = []  # of a term: (block, largest weight, first posting)
        for p in self.postings:
            own: list[tuple[int, float, int]] = []
            for k, (n, x) in enumerate(p):
                if own and own[-1][0] == n // BLOCK:
                    own[-1] = (own[-1][0], max(own[-1][1], x), own[-1][2])
                else:
                    own.append((n // BLOCK, x, k))
            self.blocks.append(own)
        self.n_blocks = -(-len(kept) // BLOCK)
        # The same bounds as arrays: those of term t are at starts[t] : starts[t + 1].
        self.starts = np.cumsum([0, *map(len, self.blocks)])
        self.block = np.array([b for own in self.blocks for b, _, _ in own], np.int64)
        self.bound = np.array([x for own in self.blocks for _, x, _ in own])

    def open_blocks(self, strides: np.ndarray, terms: np.ndarray, n_strides: int, threshold: float) -> dict[int, set[int]]:
        """Blocks that can reach the threshold in a passage: {passage: blocks}, from distinct (stride, term) pairs.

        A passage is a stride and the next.  The bounds are sums of block maxima, a word in both strides counting twice.
        """
        sizes = self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(self.starts[terms] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        cell = np.repeat(strides, sizes) * self.n_blocks + self.block[at]
        sums = np.bincount(cell, self.bound[at], n_strides * self.n_blocks).reshape(n_strides, self.n_blocks)
        both = sums.copy()
        both[:-1] += sums[1:]
        found: dict[int, set[int]] = {}
        for passage, block in zip(*(x.tolist() for x in np.nonzero(both >= threshold - 1e-9))):
            found.setdefault(passage, set()).add(block)
        return found

    def wand(self, terms: list[int], threshold: float, only: set[int] | None = None) -> list[tuple[int, float]]:
        """Block-max WAND: every (item number, score) of at least ``threshold`` for distinct terms, in item order.

        ``only``: the blocks that may be opened, if others are known not to reach the threshold.
        """
        end = 1 << 60
        cursors = []  # [item, posting, block entry, term, upper bound]
        for t in terms:
            cursors.append([self.postings[t][0][0], 0, 0, t, max(x for _, x, _ in self.blocks[t])])

        def move(c: list, item: int) -> None:
            """To the first posting of ``item`` or more, over whole blocks first."""
            blocks, postings = self.blocks[c[3]], self.postings[c[3]]
            while c[2] + 1 < len(blocks) and blocks[c[2] + 1][0] <= item // BLOCK:
                c[2] += 1
            c[1] = max(c[1], blocks[c[2]][2])
            while c[1] < len(postings) and postings[c[1]][0] < item:
                c[1] += 1
            c[0] = postings[c[1]][0] if c[1] < len(postings) else end
            while c[0] < end and c[2] + 1 < len(blocks) and blocks[c[2] + 1][2] <= c[1]:
                c[2] += 1

        allowed = sorted(only) if only is not None else None
        out, threshold = [], threshold - 1e-9
        while True:
            cursors = sorted((c for c in cursors if c[0] < end), key=lambda c: c[0])
            total, pivot = 0.0, None
            for k, c in enumerate(cursors):
                total += c[4]
                if total >= threshold:
                    pivot = k
                    break
            if pivot is None:
                return out
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block, ahead = item // BLOCK, cursors[: pivot + 1]
            if allowed is not None and block not in only:
                block = next((b for b in allowed if b > block), None)
                if block is None:
                    return out
                for c in ahead:
                    move(c, block * BLOCK)
                continue
            limit = 0.0
            for c in ahead:
                blocks = self.blocks[c[3]]
                k = c[2]
                while k + 1 < len(blocks) and blocks[k + 1][0] <= block:
                    k += 1
                limit += blocks[k][1] if blocks[k][0] == block else 0.0
            if limit < threshold:
                # No item of this block up to the next cursor's can be a result.
                after = min((block + 1) * BLOCK, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end)
                for c in ahead:
                    move(c, max(after, item + 1))
                continue
            for c in ahead:
                if c[0] < item:
                    move(c, item)
            score = sum(self.postings[c[3]][c[1]][1] for c in ahead if c[0] == item)
            if score >= threshold:
                out.append((item, score))
            for c in ahead:
                if c[0] == item:
                    move(c, item + 1)

    def leaks(self, text: bytes, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, int, float, float, float]]:
        """(item id, first word of the passage, score, question overlap, answer overlap): each leaked item once, by its best passage."""
        best: dict[int, tuple] = {}
        if not self.ids:
            return []
        for ahead, words in slabs(text, self.stride, max(2, SLAB_CELLS // max(1, self.n_blocks))):
            for row in self._in_slab(words, ahead, threshold, overlap):
                if row[0] not in best or row[1] > best[row[0]]:
                    best[row[0]] = row[1]
        return [(self.ids[i], -r[3] * self.stride, r[0], r[1], r[2]) for i, r in sorted(best.items())]

    def _in_slab(self, words: list[bytes], ahead: int, threshold: float, overlap: float) -> Iterator[tuple[int, tuple]]:
        """(item number, (score, overlaps, -passage)) of every leak in a run of strides that begins with stride ``ahead`` of the text."""
        found = np.fromiter(map(self.terms.get, words, [-1] * len(words)), np.int64, len(words))
        at = np.flatnonzero(found >= 0)
        if not len(at):
            return
        key = np.unique(at // self.stride * len(self.terms) + found[at])
        strides, terms = key // len(self.terms), key % len(self.terms)
        for passage, blocks in self.open_blocks(strides, terms, -(-len(words) // self.stride), threshold).items():
            own = np.unique(terms[(strides == passage) | (strides == passage + 1)]).tolist()
            inside = words[passage * self.stride : (passage + 2) * self.stride]
            for item, score in self.wand(own, threshold, blocks):
                share = [aligned(part, inside) for part in self.parts[item]]
                if all(enough(x, part, overlap) for x, part in zip(share, self.parts[item])):
                    yield item, (score, share[0], share[1], -passage - ahead)


def item_shards(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Index]:
    """Indexes over blocks of items of about ``SHARD_BYTES``, all with the statistics of all items; a block at a time is on the driver."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(len, words)), pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.binary()))], ["i", "t", "n", "words"])

    bounded_batches(items.sparkSession)
    slim = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t"))
    split_items = staged(slim.mapInArrow(split, "i long, t string, n long, words array<binary>").where("n > 0").withColumn("row", F.monotonically_increasing_id()), "items")
    n_items, mean, longest = split_items.agg(F.count(F.lit(1)), F.avg("n"), F.max("n")).first()
    by_word = split_items.select("row", F.explode("words").alias("word"))
    df = by_word.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    of_item = by_word.join(df, "word").groupBy("row").agg(F.collect_list(F.struct("word", "df")).alias("known"))
    shard, size, known = [], 0, {}
    for r in split_items.join(of_item, "row").select("i", "t", "known").sort("i", "t").toLocalIterator():
        if shard and size + len(r["t"]) > SHARD_BYTES:
            yield Index(shard, (known, n_items, mean, longest))
            shard, size, known = [], 0, {}
        shard.append((r["i"], r["t"]))
        size += len(r["t"])
        known.update((bytes(w), n) for w, n in r["known"])
    yield Index(shard, (known, n_items, mean, longest) if shard else None)


RESULT = "doc_id long, item_id long, passage_start long, score double, question_overlap double, answer_overlap double"


def _shared(items: DataFrame, item_id: str, item_text: str) -> list[Broadcast]:
    return [items.sparkSession.sparkContext.broadcast(index) for index in item_shards(items, item_id, item_text)]


def _indexes(shared: list[Broadcast]) -> Iterator[Index]:
    """The blocks one after the other; those over ``HELD`` are read from the executor's disk again when their turn comes."""
    for k, block in enumerate(shared):
        yield block.value
        if k >= HELD:
            del block._value


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, passage_start, score, question_overlap, answer_overlap) of every item that a document leaks."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"))
    shared = _shared(items, item_id, item_text)
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [pa.int64()] * 3 + [pa.float64()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(i, *x) for index in _indexes(shared) for i, body in zip(ids, bodies) for x in index.leaks(body or b"", threshold, overlap)]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return slim.mapInArrow(run, RESULT)


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``docs`` without the documents that leak an item, all columns kept; a text alone decides, whatever its id.  One pass, nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    shared, at = _shared(items, item_id, item_text), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [x if isinstance(x, bytes) else (x or "").encode("utf-8", "ignore") for x in batch.column(at).to_pylist()]
            clean = [True] * len(bodies)
            for index in _indexes(shared):
                for i, body in enumerate(bodies):
                    clean[i] = clean[i] and not index.leaks(body, threshold, overlap)
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
