"""Fill-in-the-middle: texts cut into prefix, middle and suffix and put in another order, by a parallel scan of an automaton.

The automaton reads UTF-8 bytes.  It counts the units (code points) that end, and the sentinels that end in the text.  A run of bytes is a function from
the state in which it is entered to the state in which it is left, with two counts for each state; runs side by side compose, and composing is associative.

* Every chunk of a text is scanned without knowing the state it is entered in: four bytes at a time through one table of all runs of four, then pairs
  of runs, level by level.  The levels stay as a tree; the k-th unit of a chunk is found by walking down from its root.
* A text of at most ``CHUNK`` bytes is one chunk, and its cuts are found where it is scanned.  Longer texts are dealt out by chunk over all tasks: the chunks'
  functions, of a fixed size each, are composed by text, which resolves every chunk's entry state and the units ahead of it; the chunks that hold a cut select it; the pieces
  are put together as one text.  Both ways run the same functions.
* Null texts are empty.  Texts without a unit or with a sentinel in them stay as they are (``plain``); so does a share of all others.  Rows that
  repeat an id and a text are cut alike, each row gives a row.  A null id counts as the empty string where cuts are drawn.  An empty table gives no rows; only
  the id is kept of other columns.  An output is one value of a row, so it must fit into one, as its text does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, staged

#: Fixed: the sentinels.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk.
CHUNK = 1 << 16
#: Between characters; after "<"; after "<" and a sentinel's letter; one, two or three bytes of a character to come.
_START, _OPEN, _LETTER, _DUE = 0, 1, 2, 3
_STATES, _CLASSES = 6, 9


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of a byte; and by class and state: the next state, the units that end, the sentinels that end."""
    kind = np.zeros(256, np.uint16)  # 0: any other single byte, 8: no byte at all
    kind[0x80:0xC0], kind[0xC0:0xE0], kind[0xE0:0xF0], kind[0xF0:] = 4, 5, 6, 7
    kind[ord("<")], kind[ord(">")] = 1, 3
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        kind[ord(sentinel[1])] = 2
    step, units, hits = (np.zeros((_CLASSES, _STATES), np.int64) for _ in range(3))
    for c in range(_CLASSES):
        for s in range(_STATES):
            if c == 8:
                step[c, s] = s
            elif c == 4:  # goes on with a character
                step[c, s] = s - 1 if s > _DUE else _START
                units[c, s] = s <= _DUE
            elif c >= 5:  # starts one
                step[c, s] = _DUE + c - 5
            else:
                step[c, s] = _OPEN if c == 1 else _LETTER if c == 2 and s == _OPEN else _START
                units[c, s], hits[c, s] = 1, c == 3 and s == _LETTER
    return kind, step.astype(np.uint8), units, hits


_KIND, _STEP, _UNITS, _HITS = _automaton()


def compose(a: tuple, b: tuple) -> tuple:
    """The runs ``a`` followed by the runs ``b``: arrays of next states, units and hits by run and entry state."""
    step = a[0].astype(np.int64)
    return np.take_along_axis(b[0], step, 1), a[1] + np.take_along_axis(b[1], step, 1), a[2] + np.take_along_axis(b[2], step, 1)


def _runs_of_four() -> tuple:
    one, runs = (_STEP, _UNITS, _HITS), (_STEP, _UNITS, _HITS)
    for _ in range(3):
        n = len(runs[0])
        runs = compose(tuple(np.repeat(x, _CLASSES, 0) for x in runs), tuple(np.tile(x, (n, 1)) for x in one))
    return runs[0], runs[1].astype(np.int32), runs[2].astype(np.int32)


_FOUR = _runs_of_four()
_NOTHING = (np.arange(_STATES, dtype=np.uint8)[None], np.zeros((1, _STATES), np.int32), np.zeros((1, _STATES), np.int32))


class Scan:
    """The function of one chunk, and the tree of the functions of its parts."""

    def __init__(self, raw: bytes):
        kinds = np.full(max(4, len(raw) + -len(raw) % 4), 8, np.int64)
        kinds[: len(raw)] = _KIND[np.frombuffer(raw, np.uint8)]
        self._kinds = kinds
        number = kinds.reshape(-1, 4) @ np.array([_CLASSES**3, _CLASSES**2, _CLASSES, 1])
        level = tuple(x[number] for x in _FOUR)
        self._levels = [level]
        while len(level[0]) > 1:
            if len(level[0]) % 2:
                level = tuple(np.concatenate(x) for x in zip(level, _NOTHING))
                self._levels[-1] = level
            level = compose(tuple(x[::2] for x in level), tuple(x[1::2] for x in level))
            self._levels.append(level)
        self.step, self.units, self.hits = (x[0] for x in level)

    def end_of(self, k: int, state: int) -> int:
        """Bytes up to the end of the k-th unit if the chunk is entered in ``state``; 0 for k = 0."""
        if k == 0:
            return 0
        if k > self.units[state]:
            raise IndexError(k)
        at = 0
        for step, units, _ in reversed(self._levels[:-1]):
            at *= 2
            if k > units[at, state]:
                k -= int(units[at, state])
                state = step[at, state]
                at += 1
        at *= 4
        while True:
            kind = self._kinds[at]
            k -= int(_UNITS[kind, state])
            state = _STEP[kind, state]
            at += 1
            if k == 0:
                return at


def plan(doc_id, n: int, hits: int, plain_share: int, spm_share: int) -> tuple[str, int, int]:
    """Form of a text of n units, and the units before the end of its prefix and of its middle."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if n == 0 or hits or h3 % 100 >= 100 - plain_share:
        return "plain", 0, n
    return "spm" if h4 % 100 < spm_share else "psm", a, b


def assembled(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "plain":
        return prefix + middle + suffix
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


_FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


def _small(docs: DataFrame, kind: str, plain_share: int, spm_share: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                scan = Scan(raw)
                n = int(scan.units[_START])
                form, a, b = plan(doc_id, n, int(scan.hits[_START]), plain_share, spm_share)
                if form == "plain":
                    rows.append((n, form, None, None, raw))
                else:
                    i, j = scan.end_of(a, _START), scan.end_of(b, _START)
                    rows.append((n, form, a, b - a, assembled(form, raw[:i], raw[i:j], raw[j:])))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays[:4], arrays[4].cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.mapInArrow(run, f"doc_id {kind}, {_FIELDS}")


def _large(docs: DataFrame, kind: str, chunk: int, plain_share: int, spm_share: int) -> DataFrame:
    """The same for texts of several chunks.  Rows of equal id and text are one text here, put back by their number in each task of the input."""
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary"), F.lit(":").cast("binary"), F.col("body")), 256)
    keyed = docs.withColumn("key", key)
    copies = keyed.groupBy("key", F.spark_partition_id().alias("lot")).agg(F.count(F.lit(1)).alias("copies"))
    starts = F.sequence(F.lit(0), F.expr(f"cast((length(body) - 1) div {chunk} as int)"))
    cut = keyed.select("key", "doc_id", "body", F.explode(starts).alias("pos")).select("key", "doc_id", "pos", F.expr(f"substring(body, cast(pos * {chunk} + 1 as int), {chunk})").alias("raw"))
    # Each chunk once, dealt out over all tasks.
    chunks = staged(cut.groupBy("key", "pos").agg(F.first("doc_id").alias("doc_id"), F.first("raw").alias("raw")), "fim-chunks")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [Scan(raw) for raw in batch.column(3).to_pylist()]
            functions = [pa.array([x.tolist() for x in column], pa.list_(pa.int32())) for column in ([s.step for s in done], [s.units for s in done], [s.hits for s in done])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *functions], ["key", "doc_id", "pos", "step", "units", "hits"])

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        """Entry state of every chunk and the units ahead of it, by composing the chunks' functions in order."""
        group = group.sort_values("pos")
        state, units, hits, entered, ahead = _START, 0, 0, [], []
        for step, unit, hit in zip(group["step"], group["units"], group["hits"]):
            entered.append(state)
            ahead.append(units)
            units, hits, state = units + int(unit[state]), hits + int(hit[state]), int(step[state])
        doc_id = group["doc_id"].iloc[0]
        form, a, b = plan(None if pd.isna(doc_id) else doc_id, units, hits, plain_share, spm_share)
        return pd.DataFrame({"of": group["key"], "nth": group["pos"], "state": entered, "ahead": ahead, "n": units, "form": form, "a": a, "b": b})

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The part of every chunk that lies in the prefix, the middle and the suffix."""
        for batch in batches:
            rows = []
            for key, doc_id, pos, raw, state, ahead, n, form, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                tree, ends = None, []
                for cut_at in (a, b):
                    if cut_at <= ahead:
                        ends.append(0)
                        continue
                    tree = tree or Scan(raw)
                    inside = cut_at - ahead
                    ends.append(tree.end_of(inside, state) if inside <= tree.units[state] else len(raw))
                i, j = ends
                rows.append((key, doc_id, pos, n, form, a, b, raw[:i], raw[i:j], raw[j:]))
            columns = list(zip(*rows)) or [()] * 10
            kinds = [pa.string(), batch.schema.field(1).type, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "doc_id", "pos", "n", "form", "a", "b", "prefix", "middle", "suffix"])

    def join_up(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        first = group.iloc[0]
        plain = first["form"] == "plain"
        output = assembled(first["form"], *(b"".join(group[c]) for c in ("prefix", "middle", "suffix")))
        return pd.DataFrame({"of": [first["key"]], "doc_id": pd.Series([first["doc_id"]], dtype=object), "n": [first["n"]], "form": [first["form"]], "prefix_chars": pd.array([None if plain else first["a"]], "Int64"),
                             "middle_chars": pd.array([None if plain else first["b"] - first["a"]], "Int64"), "output": [output.decode()]})

    functions = chunks.select("key", "doc_id", "pos", "raw").mapInArrow(scan, f"key string, doc_id {kind}, pos int, step array<int>, units array<int>, hits array<int>")
    resolved = functions.groupBy("key").applyInPandas(resolve, "of string, nth int, state int, ahead long, n long, form string, a long, b long")
    found = chunks.join(resolved, (chunks["key"] == resolved["of"]) & (chunks["pos"] == resolved["nth"])).select("key", "doc_id", "pos", "raw", "state", "ahead", "n", "form", "a", "b")
    parts = found.mapInArrow(select, f"key string, doc_id {kind}, pos int, n long, form string, a long, b long, prefix binary, middle binary, suffix binary")
    outputs = parts.groupBy("key").applyInPandas(join_up, f"of string, doc_id {kind}, {_FIELDS}")
    return outputs.join(copies, F.col("of") == F.col("key")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plain_share: int = 10, spm_share: int = 20, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every whole text.

    ``plain_share`` of 100 texts stay plain, and of the others ``spm_share`` of 100 have their suffix first.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("body"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    long = F.length("body") > chunk
    return _small(slim.where(~long), kind, plain_share, spm_share).unionByName(_large(slim.where(long), kind, chunk, plain_share, spm_share))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of: none of its parts holds a sentinel, so the sentinels of the form are the only ones."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
