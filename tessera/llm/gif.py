"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

`decode` follows the GIF89a rules: a frame is drawn on the canvas through its palette (local, else global), transparent
pixels leave the canvas as it is, and disposal 2 clears the frame's area while 3 restores what was there before it.
`frames` stores one row per frame; `encode` writes lossless 8-bit indexed frames.

A null value, an empty one and bytes that aren't a whole GIF give one row with ``error`` set and no frame.  Repeated
rows give repeated frames; an empty table gives no rows; columns named in ``keep`` are carried, others ignored.
Payloads are cut into frames of ``FRAME_ROWS`` lines, so no frame is large however long the payload is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, staged

WIDTH = 192
FRAME_ROWS = 340
DELAY_CS = 4
BINS = 8
_FULL = 4096
_GREY = bytes(v for i in range(256) for v in (i, i, i))
#: Pixels that a byte stands for at most: a code stands for under 4096, and one for many takes more than a byte.
PIXELS_A_BYTE = 4096
#: Bytes of code streams that are decoded in the same steps.
TOGETHER = 1 << 17


def _widths(minimum: int, n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code: entries come one code late."""
    entries = (1 << minimum) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(np.floor(np.log2(np.minimum(entries, _FULL - 1))).astype(np.int64) + 1, 12)


_STARTS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _starts(minimum: int, n: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Bit offsets and widths of the codes after a clear code."""
    if (minimum, n) not in _STARTS:
        w = _widths(minimum, n)
        _STARTS[minimum, n] = np.cumsum(w) - w, w
    return _STARTS[minimum, n]


#: At 256 times a code plus a byte: 256 times the code of both, 0 if there is none. All of it is 0 between calls.
_LONGER: list[int] = []


def lzw_encode(data: bytes, minimum: int = 8) -> bytes:
    """Variable-width LZW; the table is cleared when it is full."""
    clear, end, first = 1 << minimum, (1 << minimum) + 1, (1 << minimum) + 2
    if not _LONGER:
        _LONGER.extend([0] * (_FULL << 8))
    limit = _FULL - first
    segments: list[np.ndarray] = []
    keys: list[int] = []
    longer, add = _LONGER, keys.append
    new, full = first << 8, _FULL << 8

    def cut(*last: int) -> None:
        for key in keys:
            longer[key] = 0
        segments.append(np.array([*keys, *last], np.int64) >> 8)
        keys.clear()

    rest = iter(data)
    now = next(rest, -1) << 8
    for byte in rest:
        key = now + byte
        code = longer[key]
        if code:
            now = code
            continue
        add(key)
        longer[key] = new
        new += 256
        now = byte << 8
        if new == full:
            cut()
            new = first << 8
    cut(*([now] if data else []))
    # The clear code before each segment is the last code of the table before it; the first one has the starting width.
    values, sizes = [np.array([clear])], [np.array([minimum + 1])]
    offsets, widths = _starts(minimum)
    for k, segment in enumerate(segments):
        n = len(segment)
        values += [segment, np.array([end if k == len(segments) - 1 else clear])]
        sizes.append(widths[: n + 1])
    value, size = np.concatenate(values), np.concatenate(sizes)
    at = np.cumsum(size) - size
    shifted, byte = value << (at & 7), at >> 3
    total = int(at[-1] + size[-1] + 7 >> 3)
    out = sum(np.bincount(byte + k, shifted >> 8 * k & 255, total + 3) for k in range(3))
    assert limit <= len(offsets)
    return out[:total].astype(np.uint8).tobytes()


def _code_blocks(raw: bytes, minimum: int) -> Iterator[np.ndarray]:
    """The codes between clear codes, up to the end code or where the codes stop."""
    clear, end = 1 << minimum, (1 << minimum) + 1
    b = np.frombuffer(raw + b"\0\0\0", np.uint8).astype(np.int64)
    bits, at, position, parts = len(raw) * 8, 0, 0, []
    offsets, widths = _starts(minimum)
    while at < bits:
        if position + 1 >= len(offsets) - 2048:
            off, w = np.arange(2048) * 12, np.full(2048, 12)
        else:
            off, w = offsets[position : position + 2048] - offsets[position], widths[position : position + 2048]
        off = off[: np.searchsorted(off + w, bits - at, "right")] + at
        if not len(off):
            break
        w = w[: len(off)]
        byte = off >> 3
        codes = ((b[byte] | b[byte + 1] << 8 | b[byte + 2] << 16) >> (off & 7)) & ((1 << w) - 1)
        special = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(special[0]) if len(special) else len(codes)
        parts.append(codes[:stop])
        position += stop
        if stop == len(codes):
            at = int(off[-1] + w[-1])
            continue
        at = int(off[stop] + w[stop])
        if codes[stop] == end:
            break
        yield np.concatenate(parts)
        parts, position = [], 0
    if parts:
        yield np.concatenate(parts)


def lzw_decode_all(streams: list[tuple[bytes, int, int]]) -> list[bytes]:
    """What `lzw_decode` gives for each (code stream, minimum, limit), all of them in the same numpy steps.

    Code i after a clear code adds the entry of its own bytes and the first byte of code i + 1, so a code beyond the literals leads to an earlier code of one
    byte less, and on to a literal. First bytes come from there; then all codes put their last byte, go to the code before and put its last byte before that.
    """
    blocks, of_stream, clears = [], [], []
    for k, (raw, minimum, limit) in enumerate(streams):
        if not 1 <= minimum <= 11:
            raise ValueError("LZW minimum code size out of range")
        got = 0
        for codes in _code_blocks(raw, minimum):
            if got >= limit:
                break
            if len(codes):
                blocks.append(codes)
                of_stream.append(k)
                clears.append(1 << minimum)
                got += len(codes)
    if not blocks:
        return [b""] * len(streams)
    n, codes, of_stream = np.array(list(map(len, blocks))), np.concatenate(blocks), np.array(of_stream)
    head, clear, own = np.cumsum(n) - n, np.repeat(clears, n), np.arange(len(codes))
    of = np.where(codes < clear, own, codes - clear - 2 + np.repeat(head, n))
    wrong = np.where(codes < clear, codes > 255, of >= own)
    of[wrong] = own[wrong]
    entry = of != own
    size, first = 1 + entry, of
    while ((further := first[first]) != first).any():
        size += size[first] - 1
        first = further
    last = codes.astype(np.uint8)
    last[entry] = codes[first[of[entry] + 1]]
    start = np.cumsum(size) - size
    start -= np.repeat(start[head[np.searchsorted(of_stream, of_stream)]], n)
    limits = np.array([limit for *_, limit in streams])[of_stream]
    if np.logical_or.reduceat(wrong, head)[start[head] < limits].any():
        raise ValueError("LZW code outside the table")
    size[start >= np.repeat(limits, n)] = 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]), np.uint8)
    # Longest first, so the codes with bytes left are always the first ones.
    now = np.argsort(-size.astype(np.int16), kind="stable")
    place, left = ends[now] - 1, len(now) - np.cumsum(np.bincount(size))
    for step, m in enumerate(left[:-1].tolist()):
        now = of[now[:m]] if step else now[:m]
        out[place[:m] - step] = last[now]
    bounds = np.concatenate(([0], ends))[np.concatenate((head, [len(codes)]))[np.searchsorted(of_stream, np.arange(len(streams) + 1))]].tolist()
    return [out[a:b].tobytes()[:limit] for a, b, (*_, limit) in zip(bounds, bounds[1:], streams)]


def lzw_decode(raw: bytes, minimum: int, limit: int) -> bytes:
    """At most ``limit`` bytes of the code stream; it ends at the end code or where the codes stop."""
    return lzw_decode_all([(raw, minimum, limit)])[0]


@dataclass
class Frame:
    number: int
    x: int
    y: int
    width: int
    height: int
    delay_ms: int
    start_ms: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray  # (height, width, 4) of the whole picture while the frame shows

    def area(self) -> np.ndarray:
        return self.canvas[self.y : self.y + self.height, self.x : self.x + self.width]


def _blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        n = raw[at]
        if not n:
            return b"".join(parts), at + 1
        if at + 1 + n > len(raw):
            raise ValueError("a GIF block is cut short")
        parts.append(raw[at + 1 : at + 1 + n])
        at += 1 + n


def _palette(raw: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 128:
        return None, at
    n = 2 << (flags & 7)
    if at + 3 * n > len(raw):
        raise ValueError("a GIF palette is cut short")
    colours = np.full((256, 4), (0, 0, 0, 255), np.uint8)
    colours[:n, :3] = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3)
    return colours, at + 3 * n


@dataclass
class _Image:
    """A frame before it is drawn."""

    wide: int
    high: int
    place: tuple[int, int, int, int]
    woven: bool
    colours: np.ndarray
    disposal: int
    delay: int
    clear_index: int | None
    stream: tuple[bytes, int, int]


def _images(raw: bytes) -> Iterator[_Image]:
    if raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        raise ValueError("not a GIF")
    word = lambda i: raw[i] | raw[i + 1] << 8
    wide, high = word(6), word(8)
    if wide * high > PIXELS_A_BYTE * len(raw):
        raise ValueError("a GIF canvas is larger than its data can fill")
    shared, at = _palette(raw, 13, raw[10])
    disposal, delay, clear_index = 0, 0, None
    try:
        while raw[at] != 0x3B:
            if raw[at] == 0x21:
                body, after = _blocks(raw, at + 2)
                if raw[at + 1] == 0xF9 and len(body) >= 4:
                    disposal, delay, clear_index = body[0] >> 2 & 7, body[1] | body[2] << 8, body[3] if body[0] & 1 else None
                at = after
                continue
            if raw[at] != 0x2C:
                raise ValueError("unknown GIF block")
            x, y, w, h, flags = word(at + 1), word(at + 3), word(at + 5), word(at + 7), raw[at + 9]
            own, at = _palette(raw, at + 10, flags)
            colours = own if own is not None else shared
            if colours is None or x + w > wide or y + h > high:
                raise ValueError("a GIF frame has no palette or leaves the canvas")
            body, after = _blocks(raw, at + 1)
            yield _Image(wide, high, (x, y, w, h), bool(flags & 64), colours, disposal, delay, clear_index, (body, raw[at], w * h))
            at, disposal, delay, clear_index = after, 0, 0, None
    except IndexError as e:
        raise ValueError("a GIF is cut short") from e


def _drawn(images: Iterable[tuple[_Image, bytes]]) -> Iterator[Frame]:
    canvas, clock = None, 0
    for number, (image, samples) in enumerate(images):
        x, y, w, h = image.place
        if canvas is None:
            canvas = np.zeros((image.high, image.wide, 4), np.uint8)
        pixels = np.frombuffer(samples, np.uint8)
        if len(pixels) < w * h:
            raise ValueError("a GIF frame is cut short")
        pixels = pixels.reshape(h, w)
        if image.woven:
            rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            pixels = pixels[np.argsort(rows)]
        before = canvas.copy() if image.disposal == 3 else None
        area = canvas.view(np.uint32)[y : y + h, x : x + w, 0]
        shown = slice(None) if image.clear_index is None else pixels != image.clear_index
        area[shown] = image.colours.view(np.uint32)[:, 0].take(pixels)[shown]
        yield Frame(number, x, y, w, h, image.delay * 10, clock, image.disposal, image.clear_index, canvas.copy())
        if image.disposal == 2:
            area[:] = 0
        elif image.disposal == 3:
            canvas = before
        clock += image.delay * 10


def decode(raw: bytes) -> Iterator[Frame]:
    """The timed frames of a GIF; ValueError if it isn't whole."""
    return _drawn((image, lzw_decode(*image.stream)) for image in _images(raw))


def decode_all(raws: Iterable[bytes]) -> Iterator[Iterator[Frame]]:
    """`decode` of each GIF, many code streams at once; each has to be read to its end before the next. ValueError if any isn't whole."""
    def samples(gifs: list[list[_Image]]) -> Iterator[bytes]:
        streams, size = [], 0
        for image in (image for images in gifs for image in images):
            streams.append(image.stream)
            size += len(image.stream[0])
            if size > TOGETHER:
                yield from lzw_decode_all(streams)
                streams, size = [], 0
        yield from lzw_decode_all(streams)

    def drawn(gifs: list[list[_Image]]) -> Iterator[Iterator[Frame]]:
        found = samples(gifs)
        for images in gifs:
            yield _drawn((image, next(found)) for image in images)

    held, size = [], 0
    for raw in raws:
        held.append(list(_images(raw)))
        size += len(raw)
        if size > TOGETHER:
            yield from drawn(held)
            held, size = [], 0
    yield from drawn(held)


def encode(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """8-bit samples as the pixels of grey frames, ``width`` samples a line; the length must be a multiple of it."""
    lines = len(payload) // width
    if not lines or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    little = lambda n: n.to_bytes(2, "little")
    out = [b"GIF89a", little(width), little(min(lines, frame_rows)), b"\xf7\0\0", _GREY]
    for at in range(0, lines, frame_rows):
        rows = min(frame_rows, lines - at)
        out += [b"\x21\xf9\x04\x04", little(delay_cs), b"\0\0", b"\x2c\0\0\0\0", little(width), little(rows), b"\0\x08"]
        body = lzw_encode(payload[at * width : (at + rows) * width])
        for k in range(0, len(body), 255):
            out += [bytes([min(255, len(body) - k)]), body[k : k + 255]]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def histogram(pixels: np.ndarray, bins: int = BINS) -> list[list[int]]:
    """Counts of equal bins of red, green and blue over the opaque pixels."""
    seen = pixels[..., 3] > 0
    flat = pixels.reshape(-1, 4) if seen.all() else pixels[seen]
    place = np.arange(256) * bins >> 8
    return [np.bincount(place, np.bincount(flat[:, c], minlength=256), bins).astype(np.int64).tolist() for c in range(3)]


FRAME_SCHEMA = "frame int, x int, y int, width int, height int, delay_ms int, start_ms long, disposal int, transparent int, canvas_width int, canvas_height int, red array<long>, green array<long>, blue array<long>, rgba binary, error string"


def frames(media: DataFrame, gif: str = "gif", keep: tuple[str, ...] = (), pixels: bool = True) -> DataFrame:
    """One row per frame with the columns in ``keep``: place, timing, disposal, histograms of the shown canvas, its RGBA bytes."""
    bounded_batches(media.sparkSession)
    fields = FRAME_SCHEMA.split(", ")
    names = [f.split()[0] for f in fields]
    slim = media.select(*keep, F.col(gif).cast("binary").alias("__gif"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]]
    types = dict(zip(names, [pa.int32()] * 6 + [pa.int64()] + [pa.int32()] * 4 + [pa.list_(pa.int64())] * 3 + [pa.binary(), pa.string()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                def row(values: dict, i: int = i, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                    own = [batch.column(k).slice(i, 1) for k in range(batch.num_columns - 1)]
                    return pa.RecordBatch.from_arrays([*own, *(pa.array([values.get(n)], types[n]) for n in names)], [*batch.schema.names[:-1], *names])
                try:
                    for f in decode(raw or b""):
                        red, green, blue = histogram(f.canvas)
                        yield row({"frame": f.number, "x": f.x, "y": f.y, "width": f.width, "height": f.height, "delay_ms": f.delay_ms, "start_ms": f.start_ms, "disposal": f.disposal, "transparent": f.transparent, "canvas_width": f.canvas.shape[1], "canvas_height": f.canvas.shape[0], "red": red, "green": green, "blue": blue, "rgba": f.canvas.tobytes() if pixels else None})
                except ValueError as e:
                    yield row({"error": str(e)})

    return slim.mapInArrow(run, ", ".join([*kept, *fields]))


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, gif) in the shared folder: whole texts as UTF-8, padded by spaces to lines of 192, as grey frames."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            media = [encode(x + b" " * (-len(x) % WIDTH if x else WIDTH)) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "gif"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("body"))
    kind = slim.schema[0].dataType.simpleString()
    return staged(slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, gif binary"), "gif")


_TIMED = pa.list_(pa.struct([("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("disposal", pa.int32()), ("transparent", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("red", "green", "blue"))]))


def read_digests(media: DataFrame) -> DataFrame:
    """Digests of stored texts from their frames: the samples drawn, the stored bytes, times and grey histogram; and the timed frames themselves.

    ``frames`` has each frame's place in time, how it is disposed of, and its colour histograms, as `frames` gives them one a row.
    """
    bounded_batches(media.sparkSession)
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            raws = batch.column(2).to_pylist()
            for raw, drawn in zip(raws, decode_all(raws)):
                digest, tail, size, length, count, grey, shown = hashlib.sha256(), b"", 0, 0, 0, np.zeros(BINS, np.int64), []
                for f in drawn:
                    samples = f.area()[..., 0].tobytes()
                    digest.update(samples)
                    tail, size, length, count = (tail + samples)[-16:], size + len(samples), f.start_ms + f.delay_ms, count + 1
                    red, green, blue = histogram(f.area())
                    grey += red
                    shown.append({"frame": f.number, "start_ms": f.start_ms, "delay_ms": f.delay_ms, "disposal": f.disposal, "transparent": f.transparent, "width": f.width, "height": f.height, "red": red, "green": green, "blue": blue})
                rows.append((size, digest.hexdigest(), zlib.crc32(tail), len(raw), hashlib.sha256(raw).hexdigest(), f"frames={count};ms={length};grey={','.join(map(str, grey.tolist()))}", shown))
            columns = list(zip(*rows)) or [()] * 7
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), _TIMED)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"])

    return media.select("doc_id", "n_bytes", "gif").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<struct<frame: int, start_ms: long, delay_ms: int, disposal: int, transparent: int, width: int, height: int, red: array<long>, green: array<long>, blue: array<long>>>")
