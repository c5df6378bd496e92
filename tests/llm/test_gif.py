"""GIF: code streams, palettes, disposal, transparency and stored texts."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from tessera.llm import gif

# A published sample picture, 10 by 10 in four colours: white, red, blue, black.
SAMPLE = bytes.fromhex("47494638396100a000a00".replace("00a000a00", "0a000a00") + "910000ffffffff00000000ff00000021f90400000000002c000000000a000a000002168c2d99872a1cdc33a00275ec95faa8de608c04914c01003b")


def test_sample_picture():
    (frame,) = gif.decode(SAMPLE)
    index = np.select([(frame.canvas[..., :3] == c).all(-1) for c in ((255, 255, 255), (255, 0, 0), (0, 0, 255))], [0, 1, 2], 3)
    assert index[0].tolist() == [1] * 5 + [2] * 5 and index[3].tolist() == [1, 1, 1, 0, 0, 0, 0, 2, 2, 2] and index[9].tolist() == [2] * 5 + [1] * 5
    assert gif.histogram(frame.canvas)[0][-1] == 16 + 42


@pytest.mark.parametrize("minimum", [2, 3, 7, 8])
@pytest.mark.parametrize("n", [0, 1, 2, 5, 5000, 60_000])
def test_code_streams(minimum, n):
    rng = random.Random(n)
    for top in (1, 1 << minimum):
        data = bytes(rng.randrange(top) for _ in range(n))
        assert gif.lzw_decode(gif.lzw_encode(data, minimum), minimum, n) == data


def picture(frames, palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)), size=(4, 4)):
    """frames: (x, y, rows, disposal, transparent, delay, own palette, interlaced)"""
    out = b"GIF89a" + bytes([size[0], 0, size[1], 0, 0x81, 0, 0]) + bytes(v for c in palette for v in c)
    for x, y, rows, disposal, clear, delay, own, woven in frames:
        h, w = len(rows), len(rows[0])
        out += bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, 0, clear or 0, 0])
        out += bytes([0x2C, x, 0, y, 0, w, 0, h, 0, (0x81 if own else 0) | (0x40 if woven else 0)]) + bytes(v for c in own or () for v in c)
        order = [i for a, b in ((0, 8), (4, 8), (2, 4), (1, 2)) for i in range(a, h, b)] if woven else range(h)
        body = gif.lzw_encode(bytes(v for i in order for v in rows[i]), 2)
        out += b"\x02" + bytes([len(body)]) + body + b"\0"
    return out + b"\x21\xfe\x03abc\0;"


def colours(frame):
    return [["." if not p[3] else "krgb"[int(np.argmax(p[:3])) + 1 if any(p[:3]) else 0] for p in row] for row in frame.canvas.tolist()]


def test_disposal_and_transparency():
    full = [[1] * 4] * 4
    dot = [[2, 0], [0, 2]]
    raw = picture([(0, 0, full, 1, None, 5, None, False), (1, 1, dot, 2, 0, 7, None, False), (0, 0, [[3]], 3, None, 9, None, False), (3, 3, [[0]], 0, None, 1, ((0, 0, 255),) * 4, False)])
    got = list(gif.decode(raw))
    assert [(f.delay_ms, f.start_ms, f.disposal, f.transparent) for f in got] == [(50, 0, 1, None), (70, 50, 2, 0), (90, 120, 3, None), (10, 210, 0, None)]
    assert colours(got[0]) == [["r"] * 4] * 4
    assert colours(got[1]) == [["r"] * 4, list("rgrr"), list("rrgr"), ["r"] * 4]
    assert colours(got[2]) == [list("brrr"), list("r..r"), list("r..r"), list("rrrr")]
    assert colours(got[3]) == [list("rrrr"), list("r..r"), list("r..r"), list("rrrb")]


def test_interlaced_rows():
    rows = [[i % 4, 1, 2, 3] for i in range(4)]
    (a,), (b,) = (gif.decode(picture([(0, 0, rows, 0, None, 0, None, w)])) for w in (False, True))
    assert (a.canvas == b.canvas).all()


def test_payloads_round_trip():
    rng = random.Random(1)
    for n in (192, 192 * 3, 192 * 340, 192 * 341, 192 * 1000):
        for top in (1, 256):
            payload = bytes(rng.randrange(top) for _ in range(n))
            got = list(gif.decode(gif.encode(payload)))
            assert b"".join(f.area()[..., 0].tobytes() for f in got) == payload
            assert len(got) == -(-n // (192 * gif.FRAME_ROWS)) and got[-1].start_ms == 40 * (len(got) - 1)
    with pytest.raises(ValueError):
        gif.encode(b"")


def test_stored_texts(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "Words. " * 30_000, "a"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, gif string")
    stored = gif.store_texts(docs)
    media = {r["doc_id"]: bytes(r["gif"]) for r in stored.collect()}
    got = {r["doc_id"]: r for r in gif.read_digests(stored).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
        grey = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8).tolist()
        assert r["feature"].endswith("grey=" + ",".join(map(str, grey)))
        assert [f["frame"] for f in r["frames"]] == list(range(len(r["frames"]))) and [f["start_ms"] for f in r["frames"]] == [40 * k for k in range(len(r["frames"]))]
        assert np.sum([f["red"] for f in r["frames"]], axis=0).tolist() == grey and all(f["red"] == f["green"] == f["blue"] for f in r["frames"])
    assert got[2][1:] == got[7][1:] and got[0][1:] == got[1][1:]
    assert gif.read_digests(gif.store_texts(docs.limit(0))).count() == 0


def test_frames_table(spark):
    rows = [(1, SAMPLE), (2, None), (3, b"not"), (4, SAMPLE[:-9]), (5, SAMPLE), (5, SAMPLE)]
    got = gif.frames(spark.createDataFrame(rows, "doc_id long, gif binary"), keep=("doc_id",)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3, 4, 5, 5]
    for r in got:
        if r["doc_id"] in (1, 5):
            assert r["error"] is None and sum(r["red"]) == 100 and len(r["rgba"]) == 400 and r["frame"] == 0
        else:
            assert r["error"] and r["frame"] is None
    assert gif.frames(spark.createDataFrame([], "gif binary")).count() == 0


def test_a_header_alone_asks_for_no_memory():
    for wide, high in ((20_000, 20_000), (65_535, 65_535)):
        raw = b"GIF89a" + wide.to_bytes(2, "little") + high.to_bytes(2, "little") + b"\0\0\0\x3b\0\0\0"
        with pytest.raises(ValueError, match="larger than its data"):
            list(gif.decode(raw))


def plain_encode(data):
    """8-bit codes as bits, one byte after the other."""
    codes, known, now = [256], {bytes([i]): i for i in range(256)}, b""
    for byte in data:
        if now + bytes([byte]) in known:
            now += bytes([byte])
            continue
        codes.append(known[now])
        known[now + bytes([byte])] = len(known) + 2
        now = bytes([byte])
        if len(known) + 2 == 4096:
            codes.append(256)
            known = {bytes([i]): i for i in range(256)}
    return [*codes, *([known[now]] if now else []), 257]


def plain_decode(codes):
    table, last, parts = {}, b"", []
    for code in codes:
        if code == 256:
            table, last = {i: bytes([i]) for i in range(256)}, b""
        elif code != 257:
            entry = table[code] if code in table else last + last[:1]
            parts.append(entry)
            if last and len(table) + 2 < 4096:
                table[len(table) + 2] = last + entry[:1]
            last = entry
    return b"".join(parts)


def seconds(run):
    def once():
        began = time.process_time()
        run()
        return time.process_time() - began

    return min(once() for _ in range(5))


def texts_of_words(n, rng):
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 8))) for _ in range(400)]
    return [" ".join(rng.choices(words, k=550)).encode() for _ in range(n)]


def test_many_streams_at_once():
    rng = random.Random(3)
    payloads = [b"", b"a", bytes(9000), b"ab" * 3000, rng.randbytes(20_000), *texts_of_words(5, rng)]
    for data in payloads:
        assert plain_decode(plain_encode(data)) == data
        assert [c for codes in gif._code_blocks(gif.lzw_encode(data), 8) for c in codes.tolist()] == [c for c in plain_encode(data) if c not in (256, 257)]
    streams = [(gif.lzw_encode(x), 8, limit) for x in payloads for limit in (0, 1, len(x) // 2, len(x), len(x) + 9)]
    assert gif.lzw_decode_all(streams) == [x[:limit] for x in payloads for limit in (0, 1, len(x) // 2, len(x), len(x) + 9)]
    assert gif.lzw_decode_all([]) == []
    padded = [x + b" " * (-len(x) % 192 if x else 192) for x in [*payloads, bytes(192 * 1000)]]
    got = [b"".join(f.area()[..., 0].tobytes() for f in frames) for frames in gif.decode_all(map(gif.encode, padded))]
    assert got == padded


def test_wrong_codes_of_one_stream_are_found():
    good = gif.lzw_encode(b"abcabcabc")
    with pytest.raises(ValueError, match="outside the table"):
        gif.lzw_decode_all([(good, 8, 9), (bytes([0, 0xFF, 0xFF]), 8, 9)])


def test_small_texts_are_decoded_together():
    """At most half the time of a loop over codes; a loop in `lzw_decode` takes about three quarters of it."""
    texts = texts_of_words(60, random.Random(4))
    streams, codes = [(gif.lzw_encode(x), 8, len(x)) for x in texts], [plain_encode(x) for x in texts]
    assert 2 * seconds(lambda: gif.lzw_decode_all(streams)) < seconds(lambda: [plain_decode(c) for c in codes])
