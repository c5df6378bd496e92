"""Token ids in binary segments with Elias-Fano document boundaries.

A segment is one binary value:

====================  =====================================================================================
magic                 8 bytes ``TSRSEG01``
header                4 little-endian uint64: documents n, ids u, width of an id in bytes (2 or 4), low bits l
lower                 n values of l bits, bit-packed: the low bits of each document's end
upper                 bit vector: document i's end sets bit ``(end >> l) + i``
samples               uint32 per 256 set bits: the position of the 256th, 512th ... set bit, counted from the segment's start
ids                   u ids, little-endian, uint16 if the vocabulary fits, else uint32
====================  =====================================================================================

Each part starts at a multiple of 8 bytes.  The boundaries take about ``2 + log2(u / n)`` bits a document, and ``select``
returns the end of any document from a sample and a popcount scan of at most a few words, so no table of 64-bit offsets exists.
Segments are the rows of a Parquet table, in ascending id order by (bucket, part): Spark writes and reads them in any store.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, staged

MAGIC = b"TSRSEG01"
SAMPLE = 256
#: Ids in a segment before it is closed.
SEGMENT_IDS = 1 << 21
#: Text rows that share a bucket of ids on average.
BUCKET_ROWS = 8_192
#: Buckets at most, but for those of single ids.
BUCKETS = 1 << 16
#: Pieces in one of a worker's two generations of known ids.
CACHE = 600_000
END_ID = 0


def _pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def pack_segment(ids: np.ndarray, ends: np.ndarray, width: int) -> bytes:
    """Ids of all documents one after the other, and the position after each document's last id."""
    n, u = len(ends), len(ids)
    low = max(0, (u // max(n, 1)).bit_length() - 1)
    e = ends.astype(np.uint64)
    bits = ((e[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1)
    upper = np.zeros((u >> low) + n + 1, np.uint8)
    marks = (e >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper[marks] = 1
    parts = [np.packbits(bits, bitorder="little").tobytes(), np.packbits(upper, bitorder="little").tobytes(), marks[::SAMPLE].astype("<u4").tobytes(), ids.astype(f"<u{width}").tobytes()]
    return MAGIC + np.array([n, u, width, low], "<u8").tobytes() + b"".join(map(_pad, parts))


class Segment:
    """Reads a segment in place."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token segment")
        self.n, self.u, width, self.low = (int(x) for x in np.frombuffer(raw, "<u8", 4, 8))
        sizes = [-(-self.n * self.low // 8), -(-((self.u >> self.low) + self.n + 1) // 8), 4 * -(-self.n // SAMPLE), width * self.u]
        at, views = 40, []
        for size in sizes:
            views.append((at, size))
            at += size + -size % 8
        if at != len(raw):
            raise ValueError("a token segment is cut short")
        self._lower = np.frombuffer(raw, np.uint8, sizes[0], views[0][0])
        self._words = np.frombuffer(raw, "<u8", (sizes[1] + 7) // 8, views[1][0])
        self._samples = np.frombuffer(raw, "<u4", sizes[2] // 4, views[2][0])
        self.ids = np.frombuffer(raw, f"<u{width}", self.u, views[3][0])

    def _low_bits(self, i: int) -> int:
        bit = i * self.low
        raw = int.from_bytes(self._lower[bit >> 3 : (bit + self.low + 7) >> 3].tobytes(), "little")
        return raw >> (bit & 7) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """The position after document i's last id."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self._samples[i // SAMPLE]), i % SAMPLE
        word = at >> 6
        bits = int(self._words[word]) >> (at & 63) << (at & 63)
        while (c := bits.bit_count()) <= left:
            left, word = left - c, word + 1
            bits = int(self._words[word])
        for _ in range(left):
            bits &= bits - 1
        mark = (word << 6) + (bits & -bits).bit_length() - 1
        return (mark - i) << self.low | self._low_bits(i)

    def ends(self) -> np.ndarray:
        """All ends at once: select over every document in numpy."""
        marks = np.flatnonzero(np.unpackbits(self._words.view(np.uint8), bitorder="little"))[: self.n]
        high = (marks - np.arange(self.n)) << self.low
        bits = np.unpackbits(self._lower, bitorder="little")[: self.n * self.low].reshape(self.n, self.low).astype(np.int64)
        return high + bits @ (1 << np.arange(self.low, dtype=np.int64))

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.select(i - 1) if i else 0 : self.select(i)]


def _byte_level(file: dict) -> bool:
    """Whether a tokenizer's file says what `CachedEncoder` takes for granted."""
    rule, model = file["pre_tokenizer"] or {}, file["model"]
    return (
        file["normalizer"] is None and rule.get("type") == "ByteLevel" and rule.get("use_regex") is True and rule.get("add_prefix_space") is False and model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in file["added_tokens"])
    )


class CachedEncoder:
    """Encodes by the tokenizers library, remembering pieces that repeat.

    A byte-level pre-tokenizer always cuts before a single space between two characters that aren't white space, so a text's
    ids are those of its chunks between such spaces.  Chunks of Latin characters are cut further by the tokenizer's own
    pattern (fixed, below) into words, which go to its model at once; any other chunk goes through the whole tokenizer.
    Known words are kept in two generations: when the younger is full, the older is forgotten.

    A text that holds one of the tokenizer's added tokens (such as ``<|endoftext|>``, which the library gives its own id) goes through the
    library whole, and so does every text of a tokenizer that isn't byte-level BPE with that pattern, as its file says.
    """

    #: Fixed: the pre-tokenizer's pattern.
    _PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    _LATIN = re.compile(r"[\t\n\r -~\u00a1-\u024f]+")
    _CUT = re.compile(r"(?<=\S) (?=\S)")
    _MARKS = frozenset(".,;:!?")

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known_rule = _byte_level(json.loads(self.tokenizer.to_str()))
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.model, self.cache, self.young, self.old = self.tokenizer.model, cache, {}, {}
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 up, in order.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        other = iter(range(256, 512))
        self.alphabet = {b: b if b in plain else next(other) for b in range(256)}
        self.space = chr(self.alphabet[32])
        self.mark = {m: self._whole(m) for m in self._MARKS} if self.known_rule else {}

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a space and letters."""
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.model.tokenize(self.space + mapped)]).tobytes()

    def _find(self, chunk: str) -> bytes | None:
        """Ids of a space and the chunk, by way of what is known; None if there is other white space beside a space."""
        found = self.old.get(chunk)
        if found is None:
            if chunk[-1:] in self.mark and chunk[:-1].isalpha():
                body = chunk[:-1]
                return (self.young.get(body) or self._find(body)) + self.mark[chunk[-1]]
            if chunk.isalpha():
                found = self._word(chunk)
            elif chunk[:1] == "\n":
                # A line feed that `encode` cut at, with no space before it: the word after it has none either.
                if len(chunk) == 1 or chunk[1].isspace() or chunk[-1].isspace():
                    return None
                found = b"".join(map(self._piece, self._PATTERN.findall(chunk))) if self._LATIN.fullmatch(chunk) else self._whole(chunk)
            elif not chunk or chunk[0].isspace() or chunk[-1].isspace():
                return None
            elif self._LATIN.fullmatch(chunk) and len(pieces := self._PATTERN.findall(" " + chunk)) > 1:
                return b"".join(map(self._piece, pieces))
            else:
                found = self._whole(" " + chunk)
        self._keep(chunk, found)
        return found

    def _keep(self, key: str, found: bytes) -> None:
        if len(self.young) >= self.cache:
            self.old, self.young = self.young, {}
        self.young[key] = found

    def _piece(self, piece: str) -> bytes:
        """Ids of one word of the pattern; those without a space before them are known under a space more, which no chunk starts with."""
        if piece[0] == " " and not piece.isspace():
            return self.young.get(piece[1:]) or self._find(piece[1:])
        key = " " + piece
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key) or self._whole(piece)
            self._keep(key, found)
        return found

    def _spaced(self, text: str) -> bytes:
        """A text with runs of white space: cut only at spaces between other characters."""
        chunks = self._CUT.split(text)
        return self._whole(chunks[0]) + b"".join(self._whole(" " + c) if c[0].isspace() else self.young.get(c) or self._find(c) or self._whole(" " + c) for c in chunks[1:])

    def encode(self, texts: pa.Array, end_id: int | None = None) -> pa.Array:
        """Ids of every text as packed bytes, each text's with ``end_id`` after them; null texts are empty.

        Arrow cuts all texts at spaces and numbers their different chunks, so Python sees a chunk once in a batch.  A line feed is
        cut like a space but stays with the word after it; one put before each text makes its first chunk such a word.
        """
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return pa.array([], pa.binary())
        if not self.known_rule:
            end = b"" if end_id is None else array(self.code, [end_id]).tobytes()
            return pa.array([self._whole(t) + end for t in texts.to_pylist()], pa.binary())
        cut = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        chunks = pc.list_flatten(cut).dictionary_encode()
        number = chunks.indices.to_numpy()
        bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(cut).to_numpy())))
        get, ids = self.young.get, []
        for chunk in chunks.dictionary.to_pylist():
            found = get(chunk)
            if found is None:
                found = self._find(chunk)
                get = self.young.get
            ids.append(found)
        bad = np.fromiter((x is None for x in ids), bool, len(ids))
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        slow = np.flatnonzero(np.logical_or.reduceat(bad[number], bounds[:-1]) | whole) if bad.any() or whole.any() else np.empty(0, np.int64)
        # Texts with runs of white space, or an added token, are encoded one by one: each is its own first chunk, and its other chunks are empty.
        fed, empty = self._whole("\n"), len(ids)
        end = b"" if end_id is None else array(self.code, [end_id]).tobytes()
        ids = [*(x or b"" for x in ids), b"", end, *(fed + (self._whole if whole[i] else self._spaced)(texts[int(i)].as_py()) for i in slow)]
        chosen = number.astype(np.int64)
        for k, i in enumerate(slow.tolist()):
            chosen[bounds[i] : bounds[i + 1]] = empty
            chosen[bounds[i]] = empty + 2 + k
        chosen = np.insert(chosen, bounds[1:], empty + 1)
        closed = bounds + np.arange(len(bounds))
        flat = np.frombuffer(b"".join(ids), f"<u{self.width}")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        starts, lengths = (np.cumsum(sizes) - sizes)[chosen], sizes[chosen]
        # The line feed that was put before each text goes.
        skip = len(fed) // self.width
        starts[closed[:-1]] += skip
        lengths[closed[:-1]] -= skip
        after = np.cumsum(lengths)
        out = flat[np.repeat(starts - (after - lengths), lengths) + np.arange(after[-1])]
        offsets = np.concatenate(([0], after[closed[1:] - 1])) * self.width
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())


_encoders: dict[str, CachedEncoder] = {}


def _encoder(path: str) -> CachedEncoder:
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]


def write_segments(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Tokenize whole texts into the segment table (bucket, part, doc_ids, payload) in the shared folder.

    Null texts are empty; each document's ids end with ``end_id``.  Buckets are ranges of ids, cut by Spark's range partitioning of
    the id column alone, so texts are tokenized once and only their ids are shuffled; there are ``BUCKETS`` at most.  Ids that hold more
    rows than a few buckets have buckets of their own, as many as they need.  Null ids come first; rows that repeat an
    id follow each other.  An empty table gives no segment.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    width = _encoder(tokenizer).width
    ids_only = docs.select(F.col(doc_id).cast("long").alias("i"))
    rows = ids_only.count()
    buckets = min(BUCKETS, max(1, -(-rows // BUCKET_ROWS)))
    each = max(1, rows // buckets)
    # The last id of every range, and of ids with many rows how many buckets they take: both bounded by the number of buckets.
    ranged = ids_only.where("i IS NOT NULL").repartitionByRange(buckets, "i").groupBy(F.spark_partition_id().alias("b")).agg(F.max("i").alias("last"))
    cuts = {r["last"]: 1 for r in ranged.select("last").collect()}
    hot = {r["i"]: -(-r["n"] // each) for r in ids_only.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * each).collect()}
    nulls = hot.pop(None, 1)
    for i, n in hot.items():
        cuts.setdefault(i - 1, 1)
        cuts[i] = n
    edges = np.array(sorted(cuts), np.int64)
    parts = np.array([nulls, *(cuts[i] for i in edges.tolist()), 1], np.int64)
    first = np.cumsum(parts) - parts
    total = int(parts.sum())

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, turn = _encoder(tokenizer), TaskContext.get().partitionId()
        for batch in batches:
            key = batch.column(0)
            place = np.where(key.is_null().to_numpy(zero_copy_only=False), 0, 1 + np.searchsorted(edges, key.fill_null(0).to_numpy(), "left"))
            bucket = first[place] + (turn + np.arange(len(key))) % parts[place]
            turn += len(key)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), key, encoder.encode(batch.column(1), end_id)], ["bucket", "doc_id", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, held, keys, size = None, 0, [], [], 0

        def flush():
            flat = np.frombuffer(b"".join(held), f"<u{width}")
            payload = pack_segment(flat, np.cumsum([len(x) // width for x in held]), width)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([part], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([payload], pa.binary())], ["bucket", "part", "doc_ids", "payload"])

        for batch in batches:
            for bucket, key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if held and (bucket != now or size >= segment_ids * width):
                    yield flush()
                    part, held, keys, size = part + 1 if bucket == now else 0, [], [], 0
                now = bucket
                held.append(ids)
                keys.append(key)
                size += len(ids)
        if held:
            yield flush()

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    tokens = slim.mapInArrow(tokenize, "bucket int, doc_id long, ids binary")
    placed = tokens.repartitionById(total, "bucket").sortWithinPartitions("bucket", "doc_id")
    return staged(placed.mapInArrow(pack, "bucket int, part int, doc_ids array<long>, payload binary"), "token-segments")


def read_segments(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the stored segments alone.

    ``start`` counts the ids of all documents before it over all segments.
    """
    bounded_batches(segments.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, part, keys, payload in zip(*(c.to_pylist() for c in batch.columns)):
                segment = Segment(payload)
                ends = np.fromiter(map(segment.select, range(segment.n)), np.int64, segment.n)
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                crc = [zlib.crc32(segment.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array(starts), pa.array((ends - starts).astype(np.int64)), pa.array(crc, pa.int64())], ["bucket", "part", "doc_id", "local", "n_tokens", "ids_crc32"])

    rows = staged(segments.select("bucket", "part", "doc_ids", "payload").mapInArrow(run, "bucket int, part int, doc_id long, local long, n_tokens long, ids_crc32 long"), "token-rows")
    sizes = rows.groupBy("bucket", "part").agg(F.sum("n_tokens").alias("ids"))
    whole = sizes.groupBy("bucket").agg(F.sum("ids").alias("ids"))
    ahead = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = whole.select("bucket", ahead(Window.orderBy("bucket")).alias("before_bucket"))
    parts = sizes.select("bucket", "part", ahead(Window.partitionBy("bucket").orderBy("part")).alias("before_part"))
    bases = staged(parts.join(whole, "bucket").select("bucket", "part", (F.col("before_bucket") + F.col("before_part")).alias("base")), "token-bases")
    return rows.join(bases, ["bucket", "part"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
