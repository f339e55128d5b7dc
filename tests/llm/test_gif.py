import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from farebox.llm import gif


def brute_decode(stream, least):
    """A code at a time."""
    bits, n, pos, out = int.from_bytes(stream, "little"), least + 1, 0, b""
    clear = 1 << least
    table, prev = None, None
    while True:
        code = bits >> pos & (1 << n) - 1
        pos += n
        if code == clear:
            table, prev, n = {i: bytes([i]) for i in range(clear)} | {clear: b"", clear + 1: b""}, None, least + 1
            continue
        if code == clear + 1:
            return out
        now = table[code] if code in table else prev + prev[:1]
        if prev is not None and len(table) < 4096:
            table[len(table)] = prev + now[:1]
        prev = now
        out += now
        if len(table) == 1 << n and n < 12:
            n += 1


def brute_encode(data, least):
    """Without a clear code when the table is full."""
    clear, table, n, bits, pos = 1 << least, {}, least + 1, 0, 0
    table = {bytes([i]): i for i in range(clear)}
    size, w = clear + 2, b""

    def put(code):
        nonlocal bits, pos
        bits |= code << pos
        pos += n

    put(clear)
    for c in data:
        if w + bytes([c]) in table:
            w += bytes([c])
            continue
        put(table[w])
        if size < 4096:
            table[w + bytes([c])] = size
            if size == 1 << n and n < 12:
                n += 1
            size += 1
        w = bytes([c])
    put(table[w])
    if size == 1 << n and n < 12:
        n += 1
    put(clear + 1)
    return bits.to_bytes((pos + 7) // 8, "little")


DATA = [b" " * 192, bytes(range(256)) * 3, b"abc" * 5000, random.Random(1).randbytes(20_000), "Ein Text mit Wörtern, ".encode() * 900, b"a"]


@pytest.mark.parametrize("data", DATA)
def test_code_streams(data):
    stream = gif.lzw_encode(data)
    assert gif.lzw_decode(stream, 8) == data == brute_decode(stream, 8)
    assert gif.lzw_decode(brute_encode(data, 8), 8) == data


def test_other_code_sizes_and_deferred_clear():
    rng = random.Random(2)
    for least in (2, 4, 7):
        data = bytes(rng.randrange(1 << least) for _ in range(40_000))
        assert gif.lzw_decode(brute_encode(data, least), least) == data
    with pytest.raises(ValueError):
        gif.lzw_decode(b"\x00\x01", 8)


def picture(frames, size=(4, 4), colours=b"\0\0\0\xff\0\0\0\xff\0\0\0\xff"):
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0x81, 0, 0), colours]
    for disposal, transparent, left, top, w, h, flags, local, index in frames:
        out += (b"!\xf9\x04", struct.pack("<BHBB", disposal << 2 | (transparent is not None), 7, transparent or 0, 0), b"!\xfe\x03abc\0")
        out += (b",", struct.pack("<HHHHB", left, top, w, h, flags), local, b"\x02", gif._blocks(brute_encode(bytes(index), 2)))
    return b"".join((*out, b";"))


def test_disposal_transparency_palettes_interlace():
    red, green = [1] * 16, [2] * 4
    got = []
    for f in gif.decode_gif(picture([(1, None, 0, 0, 4, 4, 0, b"", red), (3, None, 1, 1, 2, 2, 0, b"", green), (2, 1, 0, 0, 2, 2, 0, b"", [1, 2, 2, 1]), (0, None, 3, 3, 4, 4, 0x81, b"\7\7\7" * 4, [0] * 16)])):
        got.append((f.delay, f.disposal, f.canvas.copy()))
    red_, green_ = [255, 0, 0, 255], [0, 255, 0, 255]
    assert (got[0][2] == red_).all() and got[0][:2] == (7, 1)
    assert (got[1][2][1:3, 1:3] == green_).all() and (got[1][2][0] == red_).all()
    assert (got[2][2][0, 1] == green_).all() and (got[2][2][0, 0] == red_).all() and (got[2][2][1, 1] == red_).all()
    assert (got[3][2][:2, :2] == 0).all() and (got[3][2][3, 3] == [7, 7, 7, 255]).all() and (got[3][2][2, 2] == red_).all()
    rows = [r for a, b in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, 4, b)]
    (f,) = gif.decode_gif(picture([(0, None, 0, 0, 4, 4, 0x40, b"", [r for r in rows for _ in range(4)])]))
    assert f.pixels[:, 0].tolist() == [[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]]


def test_rows(spark):
    rows = [(1, "abc é\n", 0), (2, None, 0), (3, "", 0), (4, "abc é\n", 0), (5, "x y " * 60_000, 0), (None, "q" * 192, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media int")
    got = {r.doc_id: r for r in gif.load_gif(gif.store_gif(df)).collect()}
    for d, text, _ in rows:
        data = (text or "").encode()
        r = got[d]
        assert bytes(r.payload) == data.ljust(max(192, -(-len(data) // 192) * 192)) and r.n_bytes == len(data)
        assert sum(sum(f.histogram) for f in r.frames) == len(r.payload) and all(f.delay_cs == gif.DELAY for f in r.frames)
    assert len(got[5].frames) == 2 and got[1].media == got[4].media
    assert gif.store_gif(df.limit(0)).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in gif.op8_gif(spark, "/root/testdata/sf0.001").collect():
        data = texts[r.doc_id].ljust(max(192, -(-len(texts[r.doc_id]) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        grey = np.bincount(np.frombuffer(data, np.uint8) >> 6, minlength=4).tolist()
        assert r.feature.endswith("rgb=" + ",".join(f"{21 * k}:{n}" for k, n in enumerate(grey) if n))
        assert r.feature.startswith(f"frames={-(-len(data) // (192 * gif.ROWS))};")


def test_colours_of_a_canvas():
    canvas = np.array([[[255, 0, 0, 255], [0, 255, 64, 255], [0, 0, 128, 0]]], np.uint8)
    got = gif.histogram(canvas)
    assert got[3 << 4] == 1 and got[3 << 2 | 1] == 1 and got.sum() == 2
