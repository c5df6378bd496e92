"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint has a bit set if more than half of its 3-word shingles' XXH64 values (seed 42) have it set.
All distinct fingerprints are compared: tiles of fingerprints meet in numpy, exclusive-or and bit counts give the
exact distances.  A tile holds the fingerprints with the same population counts in four 16-bit lanes, or in eight 8-bit lanes
where there are so many fingerprints that finer tiles cost less.  Two fingerprints differ in at least as many bits as their
lane counts differ in sum, so tile pairs beyond the radius are skipped without loss; at radius 2 a tile of four lanes meets at
most 20 others above it and itself, one of eight lanes 72.

* Equal fingerprints meet once.  A tile of more than ``TILE_ROWS`` is cut into chunks by hash, and chunk pairs are separate units of work.
* A unit returns links of a spanning forest of what it found, not all pairs, so a large group of near copies stays linear.
* What is broadcast by this module: fingerprints that hold over a 2000th of all rows, 2000 at most.  Tile counts are joined as Spark plans it.

Null texts count as empty; texts without words have fingerprint zero and are linked like any other.  Very long texts are
counted in blocks.  Repeated rows and ties share fingerprint and component.  Rows of a null id get their fingerprint's
component.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER_AZ, bounded_batches, partitions, staged
from .components import merge, roots

SEED = 42
SHINGLE = 3
RADIUS = 2
TILE_ROWS = 16_384
_BLOCK = 1 << 14


def fingerprint(text: bytes, words_each: int = SHINGLE) -> int:
    words = text.translate(LOWER_AZ).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - words_each + 1)
    lows, highs = starts[:n].tolist(), ends[-n:].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(lows[at : at + _BLOCK], highs[at : at + _BLOCK])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, rows: int = 256, columns: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of rows of a and b, fingerprints of one or more words in the order of their population counts, within ``radius`` bits.

    Tile pairs whose population counts differ by more are skipped.  With ``b is a`` every pair comes once, i < j.
    """
    ones_a, ones_b = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a, b))
    for r in range(0, len(a), rows):
        tile, ones = a[r : r + rows], ones_a[r : r + rows]
        for c in range(r if b is a else 0, len(b), columns):
            others = b[c : c + columns]
            if ones_b[c] - ones[-1] > radius or ones[0] - ones_b[c + len(others) - 1] > radius:
                continue
            apart = np.bitwise_count(tile[:, None, 0] ^ others[None, :, 0])
            for k in range(1, a.shape[1]):
                apart = apart + np.bitwise_count(tile[:, None, k] ^ others[None, :, k])
            i, j = np.nonzero(apart <= radius)
            i, j = i + r, j + c
            if b is a:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


class _Unit:
    """A home chunk of a tile, and what visits it; all of one have the same population counts."""

    def __init__(self, radius: int):
        self.radius, self.parts, self.own, self.out = radius, [], None, []

    def close_own(self) -> None:
        self.own = np.concatenate(self.parts) if self.parts else np.empty(0, np.uint64)
        self.root = np.arange(len(self.own))
        for i, j in self._near(self.own):
            merge(self.root, i, j)

    def _near(self, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = self.own[:, None]
        return close_pairs(own, own if others is self.own else others[:, None], self.radius)

    def visit(self, others: np.ndarray) -> None:
        if self.own is None:
            self.close_own()
        first = np.full(len(others), len(self.own))
        pairs = list(self._near(others))
        for i, j in pairs:
            np.minimum.at(first, j, i)
        for i, j in pairs:
            merge(self.root, i, first[j])
        linked = first < len(self.own)
        self.out.append((others[linked], self.own[first[linked]]))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if self.own is None:
            self.close_own()
        inner = self.root != np.arange(len(self.own))
        pairs = [*self.out, (self.own[inner], self.own[self.root[inner]])]
        return tuple(np.concatenate([p[k] for p in pairs]) for k in (0, 1))


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(done: _Unit):
            a, b = (x.view(np.int64) for x in done.links())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        now, unit = None, None
        for batch in batches:
            keys, guests = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            fps = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(guests) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if lo == hi:
                    continue
                if keys[lo] != now:
                    if unit:
                        yield from flush(unit)
                    now, unit = keys[lo], _Unit(radius)
                if guests[lo]:
                    unit.visit(fps[lo:hi])
                else:
                    unit.parts.append(fps[lo:hi])
        if unit:
            yield from flush(unit)

    return run


def _moves(lanes: int, radius: int) -> list[int]:
    """Steps from a tile to those above it that are within the radius."""
    steps = {0: 0}  # of the lanes so far: step -> bits it takes
    for k in range(lanes):
        steps = {s + d * 32**k: used + abs(d) for s, used in steps.items() for d in range(-radius, radius + 1) if used + abs(d) <= radius}
    return sorted(s for s in steps if s > 0)


def lanes_for(n: int, radius: int = RADIUS) -> int:
    """The number of lanes that costs least for n fingerprints: about 1 ns a comparison and 1000 ns a row sent.

    Of two random fingerprints, all counts of lanes of b bits are equal with chance (C(2b, b) / 4**b) ** lanes.
    """
    def cost(lanes: int) -> float:
        bits, moves = 64 // lanes, len(_moves(lanes, radius))
        return n * n * (moves + 0.5) * (comb(2 * bits, bits) / 4**bits) ** lanes + 1000.0 * n * (moves + 1)

    return min((4, 8), key=cost)


def near_links(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, lanes: int | None = None) -> DataFrame:
    """(a, b): links that connect what is within ``radius`` bits among distinct fingerprints in ``fp``.

    Lanes are digits of base 32 from 4 up, so a step out of a lane's range never meets a tile.
    """
    if radius > 4:
        raise ValueError("tiles are laid out for radii up to 4")
    lanes = lanes or lanes_for(fps.count(), radius)
    bits = 64 // lanes
    lane = [(F.bit_count(F.shiftrightunsigned("fp", bits * k).bitwiseAND(F.lit((1 << bits) - 1))) + F.lit(4)).cast("long") * F.lit(32**k) for k in range(lanes)]
    tiled = fps.select("fp", sum(lane[1:], lane[0]).alias("tile"))
    tiles = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile_rows)).cast("int").alias("chunks"))
    own = tiled.join(tiles, "tile").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    key = lambda tile, chunk: tile * F.lit(1 << 20) + chunk
    home = own.select(key(F.col("tile"), F.col("chunk")).alias("unit"), F.lit(0).alias("guest"), "fp")
    beside = own.where("chunk > 0").select("tile", F.explode(F.sequence(F.lit(0), F.col("chunk") - 1)).alias("chunk"), "fp")
    across = tiled.select(F.explode(F.array(*[F.col("tile") + F.lit(m) for m in _moves(lanes, radius)])).alias("tile"), "fp").join(tiles, "tile")
    across = across.select("tile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "fp")
    guests = beside.unionByName(across).select(key(F.col("tile"), F.col("chunk")).alias("unit"), F.lit(1).alias("guest"), "fp")
    units = home.unionByName(guests).repartition(partitions(fps.sparkSession), "unit").sortWithinPartitions("unit", "guest")
    return units.mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the component's id is the smallest id reachable over links."""
    bounded_batches(docs.sparkSession)
    slim = staged(fingerprints(docs, doc_id, text), "simhash")
    fps = staged(slim.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    linked = roots(near_links(fps, radius))
    # A root links to itself too, so that its first id counts.
    member = linked.unionByName(linked.select(F.col("b").alias("a"), "b").distinct()).withColumnRenamed("a", "fp").join(fps, "fp")
    lowest = member.groupBy("b").agg(F.min("first").alias("lowest"))
    member = member.join(lowest, "b").select("fp", "lowest")
    of = staged(fps.join(member, "fp", "left").select("fp", "n", F.coalesce("lowest", "first").alias("component_id")), "simhash-components")
    # Fingerprints of over a 2000th of the rows, 2000 at most, are looked up by broadcast; the others are joined by key.
    hot = of.where(F.col("n") * 2000 > slim.count()).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    rows = slim.join(F.broadcast(hot), "fp", "left")
    cold = rows.where("hot IS NULL").select("doc_id", "fp").join(of.select("fp", "component_id"), "fp")
    all_rows = rows.where("hot").select("doc_id", "fp", F.col("hot_id").alias("component_id")).unionByName(cold.select("doc_id", "fp", "component_id"))
    return all_rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
