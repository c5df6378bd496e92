"""Class-based n-gram scores after Brown: exchange clustering, class transitions, word emissions.

What is counted covers every training document: the count of every word, and the transitions between classes.  Clustering has two parts:

* The ``CORE`` most frequent words move one at a time between ``CLASSES`` classes, from the transitions among all of them and the end
  of a document, for as long as a move raises the likelihood of the class transitions.
* All other words of the head exchange classes in passes over the corpus: a pass sums, for each word, the classes before and after it, and moves it to the class
  under which these are likeliest.  All move at once, against the transitions of the last pass, to the first order, so a pass counts the transitions anew and
  is taken back if they have become less likely.  Words that a pass leaves where they are don't take part in the next one.  Passes end when one raises the likelihood by
  less than ``RISE`` of what all have raised it by, or moves fewer than ``STILL`` of the words.

The head is every word of at least ``LEAST`` occurrences, up to ``HEAD`` words, a bound on what is broadcast.  Words outside it, however many and however frequent, are
clustered by their form: those of one ending (the last letter and whether a mark follows it) and the same last bytes are a bucket, and buckets move in the same passes among
classes of their own, which start as the endings.  A word that was never seen is in a bucket, too.  So every word's class comes from clustering, and the end has its own.  Then

    P(word | word before) = P(class | class before) * (c + 1) / (n + v + 1)

with c the word's count, and n tokens and v words in its class, so that a word that was never seen shares one count in its class.  Transitions
are smoothed towards the classes' overall shares.

Texts are cut into words once for the counts and once for the codes of their words, which are written to the shared folder; all passes read codes.
Counts of words frequent enough to be among the ``HEAD`` first go to all executors, a bounded table; those of other words
are joined by word, after each document has summed its own repeats.  No list of all words is ever on the driver.

Null and empty texts are one end token.  Without training documents every count is zero and every score that of unseen tokens.
Repeated rows are scored as often; ties in counts are ordered by the words' bytes; other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER_AZ, bounded_batches, partitions, release, staged

CORE = 800
CLASSES = 64
HEAD = 200_000
LEAST = 2
#: Rounds of the core at most; it has always been still long before.
ROUNDS = 200
RISE = 0.01
STILL = 0.001
SMOOTH = 5.0
#: Codes that a task counts at a time, and contexts that it holds before it hands on their counts.
HELD_CODES = 1_000_000
HELD_CONTEXTS = 4_000_000
#: Different words that a task holds before it hands on their counts.
HELD_WORDS = 300_000
#: 26 letters, other letters, digits, anything else; without and with a mark after it.
ENDINGS = 58
#: Buckets of each ending, by the last bytes.
FORMS = 282
BUCKETS = ENDINGS * FORMS
_MARKS = b".,;:!?\"')]}"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER_AZ).split()


def ending(word: bytes) -> int:
    body = word.rstrip(_MARKS)
    last = body[-1] if body else 0
    kind = last - 97 if 97 <= last <= 122 else 26 if last >= 128 else 27 if 48 <= last <= 57 else 28
    return kind + 29 * (len(body) < len(word))


def bucket(word: bytes) -> int:
    """The bucket of a word outside the head: its number holds the ending."""
    return ending(word) * FORMS + zlib.crc32(word.rstrip(_MARKS)[-3:]) % FORMS


def likelihood(n: np.ndarray) -> float:
    """What of the training text's log likelihood follows from the classes: their transitions against their shares."""
    f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return f(n) - f(n.sum(1)) - f(n.sum(0))


def exchange(pairs: np.ndarray, core: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of every symbol of a square table of transition counts; the first ``core`` symbols move between ``classes`` classes."""
    size = len(pairs)
    of = np.concatenate([np.arange(core) % classes, classes + np.arange(size - core)])
    total = classes + size - core
    member = np.zeros((size, total))
    member[np.arange(size), of] = 1
    n = member.T @ pairs @ member
    left, right = n.sum(1), n.sum(0)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    k = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in range(core):
            was = of[w]
            member[w, was] = 0
            row, column, self_ = pairs[w] @ member, pairs[:, w] @ member, pairs[w, w]
            out, into = row.sum() + self_, column.sum() + self_
            n[was] -= row
            n[:, was] -= column
            n[was, was] -= self_
            left[was] -= out
            right[was] -= into
            rows, columns = n[:classes], n[:, :classes].T
            gain = (f(rows + row) - f(rows)).sum(1) + (f(columns + column) - f(columns)).sum(1)
            corner = rows[k, k]
            gain += f(corner + row[k] + column[k] + self_) + f(corner) - f(corner + row[k]) - f(corner + column[k])
            gain -= f(left[k] + out) - f(left[k]) + f(right[k] + into) - f(right[k])
            best = int(gain.argmax())
            best = was if gain[best] <= gain[was] + 1e-9 else best
            moved += best != was
            of[w] = best
            member[w, best] = 1
            n[best] += row
            n[:, best] += column
            n[best, best] += self_
            left[best] += out
            right[best] += into
        if not moved:
            break
    return of


@dataclass
class Vocabulary:
    """The most frequent words and what all counts add up to."""

    head: dict[bytes, int]  # word -> place, the most frequent first
    counts: np.ndarray  # by place
    endings: np.ndarray  # by place
    train_tokens: int
    types: int
    ends: int
    floor: int  # words of this count or more are in the head

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Places of words in the head; of others -1 less their bucket."""
        out = np.fromiter(map(self.head.get, words, [-1] * len(words)), np.int32, len(words))
        for i in np.flatnonzero(out < 0).tolist():
            out[i] = -1 - bucket(words[i])
        return out


@dataclass
class BrownModel:
    """Everything that scoring needs but the counts of words outside the head."""

    words: Vocabulary
    classes: np.ndarray  # by code: of the head's places, then of buckets from the last to the first
    transition: np.ndarray  # log10, by class before and class
    spread: np.ndarray  # log10(n + v + 1) by class
    head_share: float  # of all training words, the tokens of words in the head
    likelihoods: tuple[float, ...]  # before the passes, and after each that was kept
    moved: tuple[int, ...]  # words and buckets that each of them moved

    @property
    def passes(self) -> int:
        return len(self.moved)

    @property
    def end(self) -> int:
        return len(self.transition) - 1

    def class_of(self, word: bytes | None) -> int:
        return self.end if word is None else int(self.classes[self.words.codes([word])[0]])


def _bodies(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(*columns, F.col(text).cast("binary").alias("body"))


def _word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, c) over all of ``docs``; tasks hand on their counts whenever they hold many words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "c"])
        for batch in batches:
            for body in batch.column(0):
                counts.update(words_of(body.as_py()))
                if len(counts) > HELD_WORDS:
                    yield flush()
                    counts.clear()
        yield flush()

    return staged(_bodies(docs, text).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")


def _added_rows(rows: DataFrame, size: int) -> DataFrame:
    """Sum the packed rows of counts of each symbol, one at a time; every task sends at most one of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["symbol", "counts"])
        for batch in batches:
            for symbol, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if symbol != now:
                    if now is not None:
                        yield pack()
                    now, total = symbol, np.zeros(size, np.int64)
                total += np.frombuffer(counts, np.int64)
        if now is not None:
            yield pack()

    return rows.repartition(partitions(rows.sparkSession), "symbol").sortWithinPartitions("symbol").mapInArrow(run, "symbol int, counts binary")


def vocabulary(train: DataFrame, text: str = "text", head: int = HEAD, least: int = LEAST) -> tuple[Vocabulary, DataFrame]:
    """The head, and the table (word, c) of all words."""
    counts = _word_counts(train, text)
    ends = train.count()
    types, tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    # The head ends at the count at which one step further down would hold too many words, or rarer ones.
    floor, held = 1 << 62, 0
    for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).sort(F.desc("c")).toLocalIterator():
        if held + r["n"] > head or r["c"] < least:
            break
        floor, held = r["c"], held + r["n"]
    found = counts.where(F.col("c") >= floor).sort(F.desc("c"), "word").toArrow()
    words = found["word"].to_pylist()
    endings = np.fromiter(map(ending, words), np.int64, len(words))
    return Vocabulary(dict(zip(words, range(len(words)))), found["c"].to_numpy(), endings, tokens + ends, types + (ends > 0), ends, floor), counts


def encode(docs: DataFrame, words: Vocabulary, train: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, train, row, n_tokens, known, logs, codes, rare) of every document: all that scoring and counting read, in the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    slim = _bodies(docs, text, F.col(doc_id).alias("doc_id"), F.coalesce(train if train is not None else F.lit(True), F.lit(False)).alias("train"))
    kind = slim.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        row = TaskContext.get().partitionId() << 36
        head_log = np.log10(m.counts + 1.0)
        end_log, end_known = float(np.log10(m.ends + 1)), int(m.ends > 0)
        entry = pa.struct([("word", pa.binary()), ("tf", pa.int64())])
        for batch in batches:
            out: list[tuple] = []
            for body in batch.column(2):
                own = words_of(body.as_py())
                codes = m.codes(own)
                known = codes[codes >= 0]
                rare = Counter(own[i] for i in np.flatnonzero(codes < 0).tolist())
                out.append((row, len(own) + 1, len(known) + end_known, float(head_log[known].sum()) + end_log, codes.tobytes(), [{"word": w, "tf": n} for w, n in rare.items()]))
                row += 1
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(entry))))], ["doc_id", "train", "row", "n_tokens", "known", "logs", "codes", "rare"])

    return staged(slim.mapInArrow(run, f"doc_id {kind}, train boolean, row long, n_tokens long, known long, logs double, codes binary, rare array<struct<word: binary, tf: long>>"), "lm-rows")


def _flat(batches: Iterator[pa.RecordBatch], lut: np.ndarray, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, symbols) of some documents at a time, with an end before the first and after each; the end's code is the smallest."""
    stop, held, size = np.array([_END], np.int32), [], 0

    def symbols() -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate([stop, *held])
        return codes, np.where(codes == _END, end, lut[np.where(codes == _END, 0, codes)] if len(lut) else end)

    for batch in batches:
        for raw in batch.column(0):
            held += [np.frombuffer(raw.as_py(), np.int32), stop]
            size += len(held[-2]) + 1
            if size > HELD_CODES:
                yield symbols()
                held, size = [], 0
    if held:
        yield symbols()


_END = np.iinfo(np.int32).min
_CONTEXT = np.dtype([("context", "<u2"), ("n", "<u2")])
_MOST = np.iinfo(np.uint16).max


def _transitions(rows: DataFrame, lut: np.ndarray, size: int) -> np.ndarray:
    """Counts of (symbol before, symbol) over all rows; the end, which is the last symbol, stands before each document."""
    shared = rows.sparkSession.sparkContext.broadcast(lut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for _, flat in _flat(batches, shared.value, size - 1):
            total += np.bincount(flat[:-1] * size + flat[1:], minlength=size * size)
        table = total.reshape(size, size)
        used = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([table[i].tobytes() for i in used], pa.binary())], ["symbol", "counts"])

    out = np.zeros((size, size))
    for r in _added_rows(rows.select("codes").mapInArrow(run, "symbol int, counts binary"), size).collect():
        out[r["symbol"]] = np.frombuffer(r["counts"], np.int64)
    return out


def affinity(n: np.ndarray) -> np.ndarray:
    """By context (a class after, then a class before) and class but the end: what one such context adds to the likelihood of the transitions, to the first order."""
    share = (n.sum(0) + 1) / (n.sum() + len(n))
    p = (n + SMOOTH * share) / (n.sum(1, keepdims=True) + SMOOTH)  # P(class | class before)
    lift = np.log(p / share)
    return np.concatenate([lift[:-1].T, lift[:, :-1]])


def _exchange_pass(rows: DataFrame, lut: np.ndarray, n: np.ndarray, classes: int, head: int, movable: np.ndarray) -> np.ndarray:
    """The class of every movable place under which the classes beside it are likeliest; others keep theirs.

    Places are those of the head, then the buckets'.  Words of the head move among the first ``classes``, buckets among the others but the end.
    """
    spark, size, places = rows.sparkSession, len(n), len(lut)
    shared = spark.sparkContext.broadcast((lut, movable, affinity(n).astype(np.float32)))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(place, packed contexts and counts): a row for each word of all the documents that fit."""
        lut, movable, _ = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return key, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def packed(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            # Large counts are several entries.
            times = -(-n // _MOST)
            key, last = np.repeat(key, times), np.cumsum(times) - 1
            out = np.empty(len(key), _CONTEXT)
            out["context"], out["n"] = key % (2 * size), _MOST
            out["n"][last] = n - (times - 1) * _MOST
            place = key // (2 * size)
            starts = np.flatnonzero(np.diff(place, prepend=-1))
            offsets = (np.append(starts, len(key)) * _CONTEXT.itemsize).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(place[starts].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())])], ["place", "contexts"])

        for codes, flat in _flat(batches, lut, size - 1):
            at = np.flatnonzero(codes != _END)
            place = codes[at].astype(np.int64)
            place[place < 0] += places
            at, place = at[movable[place]], place[movable[place]] * (2 * size)
            held.append(np.unique(np.concatenate([place + flat[at + 1], place + size + flat[at - 1]]), return_counts=True))
            if sum(len(k) for k, _ in held) > HELD_CONTEXTS:
                held = [summed()]
                if len(held[0][0]) > HELD_CONTEXTS // 2:
                    yield packed(*held.pop())
        if held and sum(len(k) for k, _ in held):
            yield packed(*summed())

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums of log likelihoods; a word's rows may go on in the next batch.
        weight, now, total = shared.value[2], -1, np.zeros(size - 1)
        done: tuple[list[int], list[int]] = ([], [])
        theirs = np.arange(size - 1) >= classes

        def chosen(place: np.ndarray, sums: np.ndarray) -> list[int]:
            return np.where((place >= head)[:, None] == theirs, sums, -np.inf).argmax(1).tolist()
        for batch in batches:
            raw = batch.column(1).to_pylist()
            packed = np.frombuffer(b"".join(raw), _CONTEXT)
            place = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.fromiter(map(len, raw), np.int64, len(raw)) // _CONTEXT.itemsize)
            for a in range(0, len(place), 50_000):
                part = slice(a, a + 50_000)
                starts = np.flatnonzero(np.diff(place[part], prepend=-1))
                sums = np.add.reduceat(weight[packed["context"][part]] * packed["n"][part, None], starts, axis=0, dtype=np.float64)
                own = place[part][starts]
                if own[0] == now:
                    sums[0] += total
                elif now >= 0:
                    done[0].append(now)
                    done[1].extend(chosen(np.array([now]), total[None]))
                done[0].extend(own[:-1].tolist())
                done[1].extend(chosen(own[:-1], sums[:-1]))
                now, total = int(own[-1]), sums[-1]
        if now >= 0:
            done[0].append(now)
            done[1].extend(chosen(np.array([now]), total[None]))
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int32()), pa.array(done[1], pa.int32())], ["place", "class"])

    dealt = rows.select("codes").mapInArrow(contexts, "place int, contexts binary").repartition(partitions(spark), "place").sortWithinPartitions("place")
    found = dealt.mapInArrow(best, "place int, class int").toArrow()
    out = lut.copy()
    out[found["place"].to_numpy()] = found["class"].to_numpy()
    return out


def cluster(rows: DataFrame, words: Vocabulary, counts: DataFrame, core: int = CORE, classes: int = CLASSES) -> BrownModel:
    """The model from encoded training rows."""
    size = len(words.counts)
    core = min(core, size)
    classes = max(1, min(classes, core))
    lut = np.concatenate([np.arange(core), core + words.endings[core:], core + np.arange(BUCKETS)[::-1] // FORMS])
    pairs = _transitions(rows, lut, core + ENDINGS + 1)
    of = exchange(pairs, core, classes)
    member = np.zeros((len(of), classes + ENDINGS + 1))
    member[np.arange(len(of)), of] = 1
    lut, n = of[lut], member.T @ pairs @ member
    movable = np.arange(len(lut)) >= core
    scores, moves = [likelihood(n)], []
    while movable.any():
        new = _exchange_pass(rows, lut, n, classes, size, movable)
        counted = _transitions(rows, new, len(n))
        release(rows.sparkSession)  # the pass's shuffle files
        if (raised := likelihood(counted)) <= scores[-1]:
            break
        movable &= new != lut
        lut, n = new, counted
        scores.append(raised)
        moves.append(int(movable.sum()))
        if moves[-1] < STILL * len(lut) or scores[-1] - scores[-2] < RISE * (scores[-1] - scores[0]):
            break
    total, tokens_in = len(n), n.sum(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in batches:
            found.update(map(bucket, batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.int64())], ["bucket", "n"])

    # Words in each class: those of the head, and the others by their buckets, counted over the table of all words.
    words_in = np.bincount(lut[:size], minlength=total).astype(float)
    for r in counts.where(F.col("c") < words.floor).select("word").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        words_in[lut[-1 - r["bucket"]]] += r["n"]
    words_in[-1] += words.ends > 0
    share = (tokens_in + 1) / (tokens_in.sum() + total)
    transition = np.log10((n + SMOOTH * share) / (n.sum(1, keepdims=True) + SMOOTH))
    share = words.counts.sum() / max(1, words.train_tokens - words.ends)
    return BrownModel(words, lut, transition, np.log10(tokens_in + words_in + 1), float(share), tuple(scores), tuple(moves))


def fit(docs: DataFrame, trainable: Column | None = None, text: str = "text", core: int = CORE, classes: int = CLASSES, head: int = HEAD, least: int = LEAST) -> tuple[BrownModel, DataFrame]:
    """The model, and the table of all words' counts, from the rows for which ``trainable`` holds."""
    train = docs.where(trainable) if trainable is not None else docs
    words, counts = vocabulary(train, text, head, least)
    return cluster(encode(train.select(F.lit(0).alias("__id"), text), words, doc_id="__id", text=text), words, counts, core, classes), counts


def scores(docs: DataFrame, model: BrownModel, counts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, train, n_tokens, n_known, base_score, score, perplexity), log10 probabilities of whole texts with their end; perplexity is a token's."""
    return encoded_scores(encode(docs, model.words, doc_id=doc_id, text=text), model, counts)


def encoded_scores(rows: DataFrame, model: BrownModel, counts: DataFrame) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((model.classes, model.transition, model.spread))
    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "train", "row", "n_tokens", "known", "logs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut, transition, spread = shared.value
        end = len(transition) - 1
        for batch in batches:
            rest = []
            for raw in batch.column(len(columns)):
                codes = np.frombuffer(raw.as_py(), np.int32)
                of = np.concatenate([[end], lut[codes] if len(codes) else [], [end]]).astype(np.int64)
                rest.append(float(transition[of[:-1], of[1:]].sum() - spread[of[1:]].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(rest, pa.float64())], [*columns, "rest"])

    about = rows.select(*columns, "codes").mapInArrow(run, f"doc_id {kind}, train boolean, row long, n_tokens long, known long, logs double, rest double")
    rare = rows.select("row", F.explode("rare").alias("x")).select("row", F.col("x.word").alias("word"), F.col("x.tf").alias("tf"))
    found = rare.join(counts.where(F.col("c") < model.words.floor), "word").groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more_logs"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    base = F.lit(float(np.log10(model.words.train_tokens + model.words.types + 1)))
    return about.join(found, "row", "left").select(
        "doc_id", "train", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (logs - F.col("n_tokens") * base).alias("base_score"), (logs + F.col("rest")).alias("score"),
        F.pow(F.lit(10.0), -(logs + F.col("rest")) / F.col("n_tokens")).alias("perplexity"))


def fit_and_score(docs: DataFrame, trainable: Column, doc_id: str = "doc_id", text: str = "text", **options) -> tuple[BrownModel, DataFrame]:
    """`fit` on the rows for which ``trainable`` holds and `scores` of all, with one encoding."""
    words, counts = vocabulary(docs.where(trainable), text, options.pop("head", HEAD), options.pop("least", LEAST))
    rows = encode(docs, words, trainable, doc_id, text)
    model = cluster(rows.where("train"), words, counts, **options)
    return model, encoded_scores(rows, model, counts)
