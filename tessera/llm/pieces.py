"""SentencePiece encoding that keeps offsets, and decoding.

1. **Normalisation.**  At each place of the UTF-8 text the longest prefix that the model's compiled character map knows (a double-array trie) is
   replaced; any other character stays, an invalid byte becomes U+FFFD.  White space is escaped and, if the model says so, squeezed, and a dummy
   prefix is put in front.  Every byte of the result records the place in the text that it comes from.
2. **Merging.**  Adjacent symbols are merged, best score first, leftmost among equals, as long as their union is a piece; pieces marked unused are taken
   apart again; characters without a piece become byte pieces or the unknown piece.  No piece of such a vocabulary has white space behind another
   character, so a text is cut before each run of white space, and words that repeat are merged once.  Where a vocabulary has such a piece, or
   user-defined symbols, texts are merged whole.  Where normalisation changes nothing but spaces, the library merges the words that a worker hasn't
   met yet, many at once; everywhere else they are merged here.
3. **Projection.**  Ends of pieces in the normalised text, looked up in the alignment, are the byte spans of the pieces in the original text.  They are
   contiguous and cover the text but for white space that normalisation removed at its ends.  Of byte pieces of one character the last has its span.

Null texts are empty and have no pieces; repeated rows are encoded each; a row is one text, so memory is bounded by the longest text of a batch; an empty
table gives no rows; of other columns only the id is kept.  Models are BPE: others are refused.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches

SPACE = "▁"
#: Words that a worker remembers, and the longest of them in characters.
CACHE, LONGEST = 300_000, 48
#: Texts of at most so many bytes together are encoded before they are handed on, or a single longer one.
HELD_BYTES = 1 << 20
_REPLACEMENT = "�".encode()
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the model format


class CharacterMap:
    """The compiled character map: four bytes with the trie's size, the trie's units, and the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self._units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self._strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest known prefix of ``text[at:]`` and its length, if there is one."""
        units, found, end = self._units, None, len(text)
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node, i = offset(units[0]), at
        while i < end:
            byte = text[i]
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= offset(unit)
            i += 1
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, i - at)
        if found is None:
            return None
        return self._strings[found[0] : self._strings.index(b"\0", found[0])], found[1]


def _character(text: bytes, at: int) -> tuple[bytes, int]:
    """The character at a place, or U+FFFD for one byte that starts none."""
    lead = text[at]
    size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    raw = text[at : at + size]
    try:
        raw.decode()
    except UnicodeDecodeError:
        return _REPLACEMENT, 1
    return raw, size


class PieceModel:
    """A BPE model file of the sentencepiece library."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        if model.trainer_spec.model_type != 2:
            raise ValueError("only BPE models are supported")
        spec = model.normalizer_spec
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix, self.fallback = model.trainer_spec.treat_whitespace_as_suffix, model.trainer_spec.byte_fallback
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.kinds = [p.type for p in model.pieces]
        self.pieces = [p.piece for p in model.pieces]
        self._scores = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type in (_NORMAL, _USER, _UNUSED)}
        # For merging short words: pieces of equal scores share a rank, the best is 0.
        levels = {x: r for r, x in enumerate(sorted({x for x, _ in self._scores.values()}))}
        self._ranks = {p: levels[x] for p, (x, _) in self._scores.items()}
        self._ids = {p: i for p, (_, i) in self._scores.items()}
        self._sizes = [1 if k == _BYTE else len(p.encode()) for k, p in zip(self.kinds, self.pieces)]
        self._width = np.array(self._sizes, np.int32)
        self._path, self._library = path, None
        self._unused = {p.piece for p in model.pieces if p.type == _UNUSED}
        self._bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.unknown = self.kinds.index(_UNKNOWN)
        users = sorted((p.piece for p in model.pieces if p.type == _USER), key=lambda p: -len(p))
        self._users = re.compile("|".join(map(re.escape, users))) if users else None
        cuts = not users and self.escape and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces)
        # A run of white space goes with what follows it.
        self._words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if cuts else re.compile(r"(?s).+")
        # What a piece decodes to.
        unk = model.trainer_spec.unk_surface.encode()
        self._surfaces = [b"" if k == _CONTROL else unk if k == _UNKNOWN else bytes([int(p[3:5], 16)]) if k == _BYTE else p.replace(SPACE, " ").encode() for k, p in zip(self.kinds, self.pieces)]
        self._bare = [s if k in (_CONTROL, _UNKNOWN, _BYTE) or not s.startswith(b" ") else s[1:] for s, k in zip(self._surfaces, self.kinds)]
        self._plain = cuts and self.dummy and not self.suffix and not self.squeeze and self.map is None
        # What merging gave for a word, packed, in two generations.
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the place in ``text`` that it comes from."""
        space = SPACE.encode() if self.escape else b" "
        if self.map is None and not self.squeeze and not self.suffix and self._users is None:
            try:
                text.decode()
            except UnicodeDecodeError:
                pass  # goes character by character
            else:
                if not text:
                    return b"", np.zeros(1, np.int64)
                width = np.where(np.frombuffer(text, np.uint8) == 32, len(space), 1)
                places = np.repeat(np.arange(len(text)), width)
                head = len(space) if self.dummy else 0
                return (space if self.dummy else b"") + text.replace(b" ", space), np.concatenate((np.zeros(head, np.int64), places, [len(text)]))
        step = self._step
        at, end = 0, len(text)
        while self.squeeze and at < end and (part := step(text, at))[0] == b" ":
            at += part[1]
        if at == end:
            return b"", np.array([at], np.int64)
        out, places, after_space = bytearray(), [], self.squeeze
        if self.dummy and not self.suffix:
            out += space
            places += [at] * len(space)
        while at < end:
            part, size = step(text, at)
            if after_space:
                part = part.lstrip(b" ")
            if part:
                after_space = self.squeeze and part.endswith(b" ")
                part = part.replace(b" ", space)
                out += part
                places += [at] * len(part)
            at += size
        while self.squeeze and out.endswith(space):
            at = places[len(out) - len(space)]
            del out[-len(space) :], places[-len(space) :]
        if self.dummy and self.suffix:
            out += space
            places += [at] * len(space)
        return bytes(out), np.array([*places, at], np.int64)

    def _step(self, text: bytes, at: int) -> tuple[bytes, int]:
        if self._users is not None and (m := self._users.match(text[at : at + 1024].decode(errors="ignore"))):
            return (raw := m[0].encode()), len(raw)
        return (self.map and self.map.longest(text, at)) or _character(text, at)

    def _short(self, word: str) -> list[str]:
        """The pieces and unknown characters of a short word: the leftmost pair of the best rank is merged until none is left."""
        get, parts = self._ranks.get, list(word)
        none = len(self._ranks)
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i] += parts[i + 1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts

    def _merge(self, word: str) -> list[int]:
        """Packed ids of a normalised word: above 24 bits an unknown piece has how many of the word's bytes it takes; all others take as many as they have."""
        if len(word) <= LONGEST and self._users is None and not self._unused:
            parts = self._short(word)
            ids = list(map(self._ids.get, parts))
            return ids if None not in ids else self._found(parts, {})
        frozen: set[int] = set()
        if self._users is None:
            symbols = list(word)
        else:
            symbols, at = [], 0
            for m in self._users.finditer(word):
                symbols += word[at : m.start()]
                frozen.add(len(symbols))
                symbols.append(m[0])
                at = m.end()
            symbols += word[at:]
        n, scores = len(symbols), self._scores
        before, after, taken_apart = list(range(-1, n - 1)), list(range(1, n + 1)), {}
        heap = []

        def pair(a: int, b: int) -> tuple | None:
            if a in frozen or b in frozen:
                return None
            union = symbols[a] + symbols[b]
            if (score := scores.get(union)) is None:
                return None
            if union in self._unused:
                taken_apart[union] = (symbols[a], symbols[b])
            return score[0], a, b, union

        heap = [p for i in range(n - 1) if (p := pair(i, i + 1))]
        heapify(heap)
        while heap:
            _, a, b, union = heappop(heap)
            if symbols[a] is None or symbols[b] is None or len(symbols[a]) + len(symbols[b]) != len(union):
                continue  # one of the two has been merged since
            symbols[a], symbols[b] = union, None
            follow = after[a] = after[b]
            if follow < n:
                before[follow] = a
                if p := pair(a, follow):
                    heappush(heap, p)
            if before[a] >= 0 and (p := pair(before[a], a)):
                heappush(heap, p)
        return self._found([s for s in symbols if s is not None], taken_apart)

    def _found(self, symbols: list[str], taken_apart: dict[str, tuple[str, str]]) -> list[int]:
        """Packed ids of symbols that nothing merges any more."""
        ids, parts = [], symbols[::-1]
        while parts:
            part = parts.pop()
            if part in taken_apart:
                parts += reversed(taken_apart[part])
            elif (found := self._ids.get(part)) is not None:
                ids.append(found)
            elif self.fallback:
                ids += map(self._bytes.__getitem__, part.encode())
            else:
                ids.append(self.unknown | len(part.encode()) << 24)
        return ids

    def _learned(self, word: str, spaced: str) -> bytes:
        """What merging gives for ``spaced``, kept under ``word``."""
        got = self._older.get(word)
        if got is None:
            got = array("i", self._merge(spaced)).tobytes()
        if len(word) <= LONGEST:
            if len(self._known) >= CACHE:
                self._older, self._known = self._known, {}
            self._known[word] = got
        return got

    def _split(self, text: bytes) -> list[str] | None:
        """The words of a text in which each word has just one space before it; None for other texts."""
        if not self._plain or b"  " in text or text.startswith(b" ") or SPACE.encode() in text:
            return None
        try:
            return text.decode().split(" ")
        except UnicodeDecodeError:
            return None

    def learn(self, texts: list[list[str] | None]) -> None:
        """Let the library merge the new ones among the words of some texts at once, for a model whose normalisation changes nothing but spaces."""
        new: set[str] = set()
        for words in texts:
            new.update(words or ())
        new -= self._known.keys()
        if len(self._known) + len(new) > CACHE:
            self._older, self._known = self._known, {}
        known, older, unmet = self._known, self._older, []
        for word in new:
            if (got := older.get(word)) is not None:
                known[word] = got
            elif word and len(word) <= LONGEST:
                unmet.append(word)
        if not unmet:
            return
        if self._library is None:
            import sentencepiece

            self._library = sentencepiece.SentencePieceProcessor(model_file=self._path)
        found = self._library.encode(unmet, num_threads=1)
        raw, at = array("i", chain.from_iterable(found)).tobytes(), 0
        for word, ids in zip(unmet, found):
            end = at + 4 * len(ids)
            known[word] = raw[at:end]
            at = end

    def encode_all(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What `encode` gives for each of some texts."""
        words = list(map(self._split, texts))
        self.learn(words)
        return [self.encode(text, own) for text, own in zip(texts, words)]

    def encode(self, text: bytes, words: list[str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text, and begin and end of each in its bytes; ``words`` are those of `_split`."""
        flat, places = self.normalise(text)
        if not flat:
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        # Words are kept as they stand in the text where each has just one space before it.
        words = self._split(text) if words is None else words
        plain = words is not None
        if not plain:
            words = ["\0" + w for w in self._words.findall(flat.decode())]
        found = list(map(self._known.get, words))
        if None in found:
            for i, got in enumerate(found):
                if got is None:
                    word = words[i]
                    found[i] = self._known.get(word) or self._learned(word, SPACE + word if plain else word[1:])
        ids = np.frombuffer(b"".join(found), np.int32)
        if not self.fallback:
            extra, ids = ids >> 24, ids & 0xFFFFFF
            ends = np.cumsum(np.where(extra > 0, extra, self._width[ids]), dtype=np.int64)
            # Neighbouring unknown pieces are one.
            last = np.append((ids[1:] != self.unknown) | (ids[:-1] != self.unknown), True)
            ids, ends = ids[last], ends[last]
        else:
            ends = np.cumsum(self._width[ids], dtype=np.int64)
        begins = np.append(0, ends[:-1])
        if self.fallback:
            # All byte pieces of a character begin where it does, and the last ends where it does.
            whole = np.append((np.frombuffer(flat, np.uint8)[ends[:-1]] & 0xC0) != 0x80, True)
            start = np.append(True, whole[:-1])
            begins = begins[np.flatnonzero(start)][np.cumsum(start) - 1]
            ends = np.where(whole, ends, begins)
        return ids, places[begins], places[ends]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each."""
        table, rest = self._surfaces, ids.tolist()
        head = []
        if self.dummy or self.squeeze:
            # The dummy prefix goes, which the first piece with a text starts with; all leading white space if it was squeezed.
            while rest and not b"".join(head):
                first = rest.pop(0)
                head.append(self._bare[first])
                if self._bare[first] is not table[first] and not self.squeeze:
                    break
        raw = b"".join([*head, *map(table.__getitem__, rest)])
        try:
            return raw.decode()
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(raw):
                try:
                    out.append(raw[at:].decode())
                    break
                except UnicodeDecodeError as e:
                    out += [raw[at : at + e.start].decode(), "�"]
                    at += e.start + 1
            return "".join(out)


_models: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *parts]).astype(np.int32)))


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """(doc_id, ids, begins, ends) of every whole text: its pieces, and the bytes of the original text that each stands for.

    With ``decode`` there is also ``decoded``, what the ids decode to.
    """
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "ids", "begins", "ends", *(["decoded"] if decode else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)

        def encoded(keys: pa.Array, texts: list) -> pa.RecordBatch:
            done = pieces.encode_all([t or b"" for t in texts])
            text = [pa.array([pieces.decode(d[0]) for d in done], pa.string())] if decode else []
            return pa.RecordBatch.from_arrays([keys, *(_lists([d[k] for d in done]) for k in range(3)), *text], names)

        for batch in batches:
            texts, first, held = batch.column(1).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                if held and held + len(t or b"") > HELD_BYTES:
                    yield encoded(batch.column(0).slice(first, i - first), texts[first:i])
                    first, held = i, 0
                held += len(t or b"")
            yield encoded(batch.column(0).slice(first), texts[first:])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("body"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, ids array<int>, begins array<int>, ends array<int>" + (", decoded string" if decode else ""))


def decoded(ids: Column, model: str) -> Column:
    """The text of a column of ids; null is the empty text."""

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        pieces = _model(model)
        flat, at = batch.flatten().to_numpy(), np.concatenate(([0], np.cumsum(batch.value_lengths().fill_null(0).to_numpy())))
        return pa.array([pieces.decode(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())

    return run(ids)
