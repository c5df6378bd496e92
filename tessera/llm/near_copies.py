"""SimHash near-dedup at a similarity: five-word shingles, Jaccard similarity of 0.8 or more, one text of each group kept.

The operator of `simhash` with fingerprints of ``BITS`` bits and a radius that this similarity needs, and two things around its tiles:

* **Blocks.** At such a radius population counts alone exclude little, so all fingerprints would have to meet.  Texts are
  compared within blocks instead: in any order of shingles that all texts share, two texts of the similarity have one in
  common among the first n - ceil(0.8 n) + 1 of each, and a block is the texts that have a shingle there.  The order puts shingles
  that are frequent in a sample last; the sample changes how large blocks are, never what is found.
* **An exact check.** Pairs within the radius have their whole sets of shingles compared.

In a block, tiles of fingerprints meet in numpy by exclusive-or and bit counts; tile pairs go whose population counts differ beyond the radius.
Two texts of a similarity of 0.8 are 19.4 of 128 bits apart on average, with a deviation of 4 (5, about 24, in sets of five
shingles): the radius of 44 is 4 deviations or more away.  A second bound is exact: the parities of the shingles by their last
byte differ in at most as many of ``PARITY`` bits as the sets differ in shingles.

A block of more than the square root of the number of texts is cut into chunks by hash.  Blocks of up to ``SMALL`` texts take all pairs at once.  In larger
ones every text of a chunk first meets ``HUBS`` of it, which links most of a large group; then all meet that aren't in the same group yet.  Of a cut block, texts outside its
largest group visit every chunk, so no pair is left out and the members of the largest group don't meet each other again.

Null texts count as empty; texts without words are copies of each other, a text of under five words is one shingle.  Equal texts are shingled once
in a task and are one text from the first shuffle on; texts are told apart by a 64-bit hash.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, maybe_in, partitions, staged, text_key
from .components import keep_one, roots
from .simhash import close_pairs

SHINGLE = 5
BITS = 128
RADIUS = 44
PARITY = 1024
#: Texts whose shingles are counted for the order, about, and the most of these shingles that are kept.
SAMPLE_ROWS = 5_000
SAMPLE_SHINGLES = 200_000
#: Texts of a chunk that all others of it meet first.
HUBS = 2
#: A block isn't cut below this, and one of fewer texts than this is compared at once.
CHUNK_ROWS = 256
SMALL = 4
#: Keys of texts that a task remembers to skip their copies.
SEEN = 200_000

#: Bytes whose words are hashed at a time.
SLICE = 1 << 19

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_BASE = 0x5851F42D4C957F2D


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(by)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        factors = np.full(max(n, SLICE), base, np.uint64)
        factors[0] = 1
        _powers[base] = np.cumprod(factors)
    return _powers[base][:n]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of every word of lower-cased bytes: a polynomial of its bytes from sums over the slice, mixed with its length."""
    space = (raw == 32) | (raw - np.uint8(9) < 5)
    firsts, hashes = [], []
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE, "right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        lower = raw[lo:hi] | (raw[lo:hi] - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((lower + np.uint64(1)) * _power(_BASE, hi - lo), out=sums[1:])
        a, b = starts[at:to] - lo, ends[at:to] - lo
        firsts.append(starts[at:to])
        hashes.append(_mixed((sums[b] - sums[a]) * _power(pow(_BASE, -1, 1 << 64), hi - lo)[a] + (b - a).astype(np.uint64), 0xBF58476D1CE4E5B9) | np.uint64(1))
        at = to
    return (np.concatenate(firsts), np.concatenate(hashes)) if firsts else (np.empty(0, np.int64), np.empty(0, np.uint64))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted different shingles of every text, words hashed in numpy over the bytes of all texts."""
    empty, space = (pa.scalar(x, pa.large_binary()) for x in (b"", b" "))
    texts = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_binary()), empty), empty, space)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[: offsets[-1]] if len(texts) else np.empty(0, np.uint8)
    first, flat = word_hashes(raw)
    doc = np.searchsorted(offsets, first, "right") - 1
    # A text of fewer words is filled up to one shingle by zeros.
    size = np.bincount(doc, minlength=len(texts))
    room = np.maximum(size, SHINGLE)
    start = np.cumsum(room) - room
    held = np.zeros(int(room.sum()), np.uint64)
    held[np.arange(len(flat)) + (start - (np.cumsum(size) - size))[doc]] = flat
    total = np.zeros(max(0, len(held) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        total += held[k : k + len(total)] * _ODD[k]
    total = _mixed(total, 0xD6E8FEB86659FD93)
    return [np.unique(total[a : a + n - SHINGLE + 1]) for a, n in zip(start.tolist(), room.tolist())]


def sketch(shingles: np.ndarray) -> bytes:
    """The fingerprint and the parities, packed."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 1 << 14):
        part = shingles[at : at + (1 << 14)]
        halves = [np.unpackbits(x.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64) for x in (part, _mixed(part, 0xFF51AFD7ED558CCD))]
        counts += np.concatenate(halves)
    odd = np.bincount((shingles & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) % 2 == 1
    return np.packbits(np.concatenate([counts * 2 > len(shingles), odd])).tobytes()


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets' similarity is 0.8 or more."""
    inside = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * inside >= 4 * (len(a) + len(b) - inside)


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(keys, texts) of (key, text) rows without copies of what the task has just seen."""
    seen: set[int] = set()
    for batch in batches:
        take = []
        for i, key in enumerate(batch.column(0).to_pylist()):
            if key not in seen:
                seen.add(key)
                take.append(i)
        if len(seen) > SEEN:
            seen.clear()
        if take:
            batch = batch.take(pa.array(take))
            yield batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)


def _frequent(slim: DataFrame, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) of those that a sample of one text in ``step`` has several times, sorted by shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _fresh(batches):
            found, n = np.unique(np.concatenate(shingle_sets(texts)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["shingle", "n"])

    counts = slim.where(F.pmod("key", F.lit(step)) == 0).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("c"))
    found = counts.where("c > 2").sort(F.desc("c"), "shingle").limit(SAMPLE_SHINGLES).toArrow()
    shingles = found["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], found["c"].to_numpy()[order]


def _meetings(slim: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(shingle, key) of prefixes, for shingles that several texts' prefixes have, and (key, n, sketch) of every text.

    Of shingles that the same texts have, one stays: near copies mostly share many.
    """
    spark = slim.sparkSession
    step, chunk = max(1, rows // SAMPLE_ROWS), max(CHUNK_ROWS, isqrt(rows))
    shared = spark.sparkContext.broadcast(_frequent(slim, step))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        mask = np.uint64((1 << 22) - 1)
        maybe = np.zeros(1 << 22, bool)
        maybe[frequent & mask] = True
        for keys, texts in _fresh(batches):
            first, often, about = [], [], []
            for own in shingle_sets(texts):
                about.append(len(own).to_bytes(8, "little") + sketch(own))
                n, of = prefix_length(len(own)), np.zeros(len(own), np.int64)
                some = np.flatnonzero(maybe[own & mask])
                if len(some):
                    at = np.minimum(np.searchsorted(frequent, own[some]), len(frequent) - 1)
                    of[some] = np.where(frequent[at] == own[some], counts[at], 0)
                    order = np.argsort(of, kind="stable")[:n]
                    own, of = own[order], of[order]
                first.append(own[:n])
                often.append(of[:n])
            shingle, often, key = np.concatenate(first).view(np.int64), np.concatenate(often), np.repeat(keys, list(map(len, first)))
            # A shingle that the sample says is frequent is dealt to several tasks; that it is shared is known already.
            parts = often * step // chunk
            salt = np.where(parts > 0, 1 + (key >> 8) % np.maximum(parts, 1), 0)
            yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(salt), pa.array(key), pa.nulls(len(key), pa.binary())], ["shingle", "salt", "key", "about"])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), -1)), pa.array(keys), pa.array(about, pa.binary())], ["shingle", "salt", "key", "about"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(sign, shingle, keys) of shingles of at least two texts, or of frequent ones, and (key, about) of texts; rows come sorted."""
        held = np.empty((3, 0), np.int64)

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(0))))
            sizes = np.diff(np.concatenate((starts, [rows.shape[1]])))
            # Texts add up to a block's sign; a part of a frequent shingle can't tell and is signed by the shingle.
            sign = np.add.reduceat(_mixed(rows[2].view(np.uint64), 0xFF51AFD7ED558CCD), starts)
            sign = np.where(rows[1, starts] > 0, _mixed(rows[0, starts].view(np.uint64), 0xC2B2AE3D27D4EB4F), sign).view(np.int64)
            for a in np.flatnonzero((sizes > 1) | (rows[1, starts] > 0)).tolist():
                for at in range(starts[a], starts[a] + sizes[a], 1 << 16):
                    yield int(sign[a]), int(rows[0, at]), rows[2, at : min(at + (1 << 16), starts[a] + sizes[a])].tobytes()

        def packed(found: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            found = list(found)
            if found:
                sign, shingle, keys = zip(*found)
                none = len(found)
                yield pa.RecordBatch.from_arrays([pa.array(sign, pa.int64()), pa.array(shingle, pa.int64()), pa.array(keys, pa.binary()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary())], ["sign", "shingle", "keys", "key", "about"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            texts = np.flatnonzero(columns[1] < 0)
            new = texts[np.diff(columns[2][texts], prepend=columns[2][texts[:1]] - 1) != 0]
            if len(new) and columns[2][new[0]] == last:
                new = new[1:]
            if len(texts):
                last = columns[2][texts[-1]]
            if len(new):
                some, none = pa.array(new), len(new)
                yield pa.RecordBatch.from_arrays([pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary()), batch.column(2).take(some), batch.column(3).take(some)], ["sign", "shingle", "keys", "key", "about"])
            rows = np.concatenate([held, np.stack(columns)[:, columns[1] >= 0]], axis=1)
            if not rows.shape[1]:
                continue
            rows = rows[:, np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(0)))]
            # The last shingle's keys wait for the next batch.
            cut = int(np.searchsorted(rows[0], rows[0, -1]))
            held = rows[:, cut:]
            if cut:
                yield from packed(flush(rows[:, :cut]))
        if held.shape[1]:
            yield from packed(flush(held))

    def first_of_sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shingle = None, None
        for batch in batches:
            found, keys = [], []
            for sign, own, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if sign != now:
                    now, shingle = sign, own
                if own == shingle:
                    keys.append(np.frombuffer(raw, np.int64))
                    found.append(np.full(len(keys[-1]), own))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(keys))], ["shingle", "key"])

    dealt = slim.mapInArrow(prefixes, "shingle long, salt long, key long, about binary").repartition(partitions(spark), "shingle", "salt").sortWithinPartitions("shingle", "salt", "key")
    both = staged(dealt.mapInArrow(blocks, "sign long, shingle long, keys binary, key long, about binary"), "copies-blocks")
    signed = both.where("sign IS NOT NULL").select("sign", "shingle", "keys").repartition(partitions(spark), "sign").sortWithinPartitions("sign", "shingle")
    about = both.where("key IS NOT NULL").select("key", "about")
    return staged(signed.mapInArrow(first_of_sign, "shingle long, key long"), "copies-met"), about


def _sets(slim: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, shingles) of the texts in ``keys``, and of some others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, texts in _fresh(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], ["key", "shingles"])

    wanted = maybe_in(slim, F.col("key"), keys)[0].select("key", "body")
    return wanted.mapInArrow(run, "key long, shingles binary").dropDuplicates(["key"])


class _Rows:
    """Texts of units: what bounds compare."""

    def __init__(self, key: np.ndarray, n: np.ndarray, packed: np.ndarray, root: np.ndarray):
        self.key, self.n, self.root, self.print, self.odd = key, n, root, packed[:, : BITS // 64], packed[:, BITS // 64 :]

    def by_ones(self) -> _Rows:
        """In the order of population counts."""
        order = np.argsort(np.bitwise_count(self.print).sum(1), kind="stable")
        return _Rows(self.key[order], self.n[order], np.concatenate((self.print, self.odd), axis=1)[order], self.root[order])

    def fit(self, i: np.ndarray, other: _Rows, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, keys) of the pairs that no root joins and neither lengths nor parities exclude."""
        a, b = self.n[i], other.n[j]
        keep = (self.root[i] != other.root[j]) & (5 * np.minimum(a, b) >= 4 * np.maximum(a, b))
        i, j = i[keep], j[keep]
        keep = 9 * np.bitwise_count(self.odd[i] ^ other.odd[j]).sum(1, dtype=np.int64) <= self.n[i] + other.n[j]
        return self.key[i[keep]], other.key[j[keep]]

    def pairs(self, other: _Rows, hub: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What tiles find, both sides in the order of population counts; with ``hub`` only that row's pairs."""
        for i, j in close_pairs(self.print if hub is None else self.print[hub : hub + 1], other.print, RADIUS):
            yield self.fit(i + (hub or 0), other, j)

    def within(self, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs inside many small units at once, one distance between rows after the other; ``unit`` is sorted."""
        for step in range(1, SMALL):
            i = np.flatnonzero(unit[step:] == unit[:-step])
            if not len(i):
                return
            i = i[np.bitwise_count(self.print[i] ^ self.print[i + step]).sum(1) <= RADIUS]
            yield self.fit(i, self, i + step)


def _candidates(units: DataFrame, hubs: int | None) -> DataFrame:
    """(a, b): different pairs to check, from rows (shingle, chunk, kind, key, about, root).

    With ``hubs`` small units give all their pairs and larger ones those with so many texts of theirs; without it the others' remaining pairs follow.
    ``kind`` is 0 for a whole block, 1 for a text in its own chunk of a cut block, 2 for one that visits another chunk.
    """
    def found(unit: tuple[int, int], kind: np.ndarray, rows: _Rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        part = lambda keep: _Rows(rows.key[keep], rows.n[keep], np.concatenate((rows.print, rows.odd), axis=1)[keep], rows.root[keep]).by_ones()
        home = part(kind < 2)
        if hubs:
            m = len(home.key)
            for h in {(unit[0] * 0x9E3779B97F4A7C15 >> 8 * k) % m for k in range(min(hubs, m))}:
                yield from home.pairs(home, h)
        else:
            yield from home.pairs(home)
            yield from part(kind == 2).pairs(home)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def packed_up() -> Iterator[pa.RecordBatch]:
            a, b = (np.concatenate([p[k] for p in out]) for k in (0, 1)) if out else ((), ())
            out.clear()
            if len(a):
                a, b = np.minimum(a, b), np.maximum(a, b)
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])

        def done(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Pairs of whole units, rows in their order."""
            shingle, chunk, kind, key, n, root, packed = columns
            cuts = np.flatnonzero((shingle[1:] != shingle[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            starts = np.concatenate(([0], cuts))
            sizes = np.diff(np.concatenate((starts, [len(key)])))
            small = (sizes <= SMALL) & (kind[starts] == 0)
            if hubs:
                keep = np.repeat(small, sizes)
                out.extend(_Rows(key[keep], n[keep], packed[keep], root[keep]).within(np.repeat(np.arange(len(sizes)), sizes)[keep]))
            for k in np.flatnonzero(~small).tolist():
                own = slice(int(starts[k]), int(starts[k] + sizes[k]))
                if (root[own] != root[own.start]).any():
                    for pair in found((int(shingle[own.start]), int(chunk[own.start])), kind[own], _Rows(key[own], n[own], packed[own], root[own])):
                        out.append(pair)
                        if sum(len(p[0]) for p in out) > 500_000:
                            yield from packed_up()
            yield from packed_up()

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3)]
            columns += [packed[:, 0].astype(np.int64), batch.column(5).to_numpy(zero_copy_only=False), packed[:, 1:]]
            # The last unit waits for the next batch.
            last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and (cut or (held[0][0][-1], held[0][1][-1]) != (columns[0][-1], columns[1][-1])):
                yield from done([np.concatenate(x) for x in zip(*held, [c[:cut] for c in columns])])
                held = []
            elif cut:
                yield from done([c[:cut] for c in columns])
            held.append([c[cut:] for c in columns])
        if held:
            yield from done([np.concatenate(x) for x in zip(*held)])

    dealt = units.select("shingle", "chunk", "kind", "key", "about", "root").repartition(partitions(units.sparkSession), "shingle", "chunk").sortWithinPartitions("shingle", "chunk", "key")
    return staged(dealt.mapInArrow(run, "a long, b long").distinct(), "copies-pairs")


def _alike(pairs: DataFrame, slim: DataFrame) -> DataFrame:
    """The pairs whose texts' whole sets are alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(fit, pa.bool_()))

    if not pairs.limit(1).count():
        return pairs
    keys = staged(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "copies-keys")
    sets = staged(_sets(slim, keys), "copies-sets")
    side = lambda k, s: sets.select(F.col("key").alias(k), F.col("shingles").alias(s))
    return staged(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "copies-links")


def near_copy_roots(docs: DataFrame, text: str = "text", hubs: int = HUBS, chunk_rows: int | None = None) -> DataFrame:
    """(a, b): the smallest text key that near copies lead to from a, for every text key a that isn't it itself."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(text_key(text).alias("key"), F.col(text).cast("string").alias("body"))
    rows = docs.count()
    met, about = _meetings(slim, rows)
    chunk = F.lit(chunk_rows or max(CHUNK_ROWS, isqrt(rows)))
    cut = met.groupBy("shingle").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > chunk).select("shingle", F.ceil(F.col("m") / chunk).alias("chunks"))
    units = met.join(about, "key").join(cut, "shingle", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("key"), F.col("chunks")), F.lit(0)).cast("long"))
    units = staged(units.select("shingle", "chunk", "chunks", F.col("chunks").isNotNull().cast("long").alias("kind"), "key", "about"), "copies-units")
    links = _alike(_candidates(units.withColumn("root", F.col("key")), hubs), slim)
    known = roots(links).select(F.col("a").alias("key"), F.col("b").alias("root"))
    units = units.join(known, "key", "left").withColumn("root", F.coalesce("root", "key"))
    in_cut = units.where("chunks IS NOT NULL")
    largest = in_cut.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("shingle").agg(F.max(F.struct("m", "root"))["root"].alias("largest"))
    away = in_cut.join(largest, "shingle").where("root != largest").withColumn("own", F.col("chunk")).withColumn("kind", F.lit(2).cast("long"))
    away = away.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).where("chunk != own")
    more = _alike(_candidates(units.unionByName(away.select(units.columns)), None), slim)
    found = roots(links.unionByName(more))
    return found


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near copies, that of the smallest id, null ids last.

    Rows are told apart by id and text, so different texts of one id, or without an id, don't stand for each other.
    """
    linked = near_copy_roots(docs, text)
    groups = linked.unionByName(linked.select(F.col("b").alias("a"), "b").distinct())
    return keep_one(docs, groups.select(F.col("a").alias("key"), F.col("b").alias("component")), doc_id, text)
