"""Media columns: GIF.

Texts are stored as 8-bit samples of an animation: the UTF-8 bytes, padded with blanks to a positive multiple of 192, are rows
of 192 pixels, up to ROWS of them a frame, under a grey palette of 256 entries, compressed by LZW. The decoder reads any
GIF: it decodes the LZW code streams, applies the global or a local palette, interlacing, transparency and the disposal
of each frame, and gives timed frames with a histogram of the canvas that a viewer sees (64 colours).

Everything is done one document at a time, so memory is bounded by the largest text of a batch.

Edge cases: a null text is empty (one row of blanks); equal texts have equal bytes and features; a damaged or
truncated file raises; texts are stored whole, the longest in many frames; other columns aren't read, whatever their names; an empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.llm.common import table, text_or_empty, written

WIDTH = 192
ROWS = 1024
DELAY = 10
BINS = 64
_FULL = 4096


def _widths(least: int) -> np.ndarray:
    """The bits of each code after a clear code, as the table grows."""
    size = np.arange((1 << least) + 1, _FULL + 2)
    return np.minimum(12, np.floor(np.log2(size)).astype(np.int64) + 1)


def lzw_encode(data: bytes) -> bytes:
    """The code stream of 8-bit samples."""
    clear, stop, free = 256, 257, 258
    codes: list[int] = [clear]
    runs = [1]
    known: dict[int, int] = {}
    get, put, last, entry = known.get, codes.append, data[0] if data else -1, free
    for c in memoryview(data)[1:]:
        key = last << 8 | c
        found = get(key)
        if found is not None:
            last = found
            continue
        put(last)
        last = c
        if entry < _FULL:
            known[key] = entry
            entry += 1
        else:
            put(clear)
            runs.append(entry - free + 2)
            known.clear()
            entry = free
    if data:
        put(last)
    put(stop)
    runs.append(len(codes) - sum(runs))
    wide = _widths(8)
    width = np.concatenate([wide[:n] for n in runs])
    bits = np.unpackbits(np.array(codes, "<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < width[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, least: int) -> bytes:
    """The samples of any GIF code stream with the given least code size."""
    clear, stop = 1 << least, (1 << least) + 1
    wide = _widths(least)
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    start = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    put, at, total = out.append, 0, len(stream) * 8
    while True:
        room = (total - at) // (least + 1) + 1
        width = wide[:room] if room <= wide.size else np.concatenate([wide, np.full(min(room - wide.size, 1 << 16), 12)])
        ends = at + np.cumsum(width)
        width = width[: int(np.searchsorted(ends, total, "right"))]
        begins = ends[: width.size] - width
        i = begins >> 3
        values = (raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) >> (begins & 7) & ((1 << width) - 1)
        marks = np.flatnonzero((values == clear) | (values == stop))
        if not marks.size:
            raise ValueError("a code stream without its end")
        codes = values[: marks[0]].tolist()
        if codes:
            entries = start.copy()
            add, before = entries.append, entries[codes[0]]
            put(before)
            size = len(entries)
            for c in codes[1:]:
                if c < size:
                    now = entries[c]
                elif c == size < _FULL:
                    now = before + before[:1]
                else:
                    raise ValueError("a code beyond the table")
                if size < _FULL:
                    add(before + now[:1])
                    size += 1
                put(now)
                before = now
        if values[marks[0]] == stop:
            return b"".join(out)
        at = int(begins[marks[0]] + width[marks[0]])


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(samples: bytes, width: int = WIDTH, rows: int = ROWS) -> bytes:
    """An animation whose frames hold the samples, rows of width pixels; their number is a multiple of width."""
    height = min(rows, len(samples) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))]
    for i in range(0, len(samples), width * rows):
        frame = samples[i : i + width * rows]
        out += (b"!\xf9\x04", struct.pack("<BHBB", 2 << 2, DELAY, 0, 0), b",", struct.pack("<HHHHB", 0, 0, width, len(frame) // width, 0), b"\x08", _blocks(lzw_encode(frame)))
    return b"".join((*out, b";"))


@dataclass
class Frame:
    delay: int
    disposal: int
    transparent: int | None
    left: int
    top: int
    pixels: np.ndarray  # colours of the frame's own rectangle, rows x columns x 3
    canvas: np.ndarray  # what is seen, rows x columns x 4 with opacity


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF in order, each with the canvas as seen while it is shown."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at = 13

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        n = 3 << ((flags & 7) + 1)
        at += n
        return np.frombuffer(data, np.uint8, n, at - n).reshape(-1, 3)

    def blocks() -> bytes:
        nonlocal at
        found = []
        while n := data[at]:
            found.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(found)

    common = palette(flags) if flags & 0x80 else np.zeros((256, 3), np.uint8)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay = disposal = 0
    transparent: int | None = None
    while (mark := data[at]) != 0x3B:
        at += 1
        if mark == 0x21:
            label, at = data[at], at + 1
            body = blocks()
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            continue
        if mark != 0x2C:
            raise ValueError("a block of an unknown kind")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        colours = palette(flags) if flags & 0x80 else common
        least, at = data[at], at + 1
        index = np.frombuffer(lzw_decode(blocks(), least), np.uint8)
        if index.size < w * h:
            raise ValueError("a frame lacks pixels")
        index = index[: w * h].reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(index)
            straight[order] = index
            index = straight
        pixels = colours[np.minimum(index, len(colours) - 1)]
        kept = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        h_in, w_in = part.shape[:2]
        if transparent is None:
            part[..., :3], part[..., 3] = pixels[:h_in, :w_in], 255
        else:
            seen = (index != transparent)[:h_in, :w_in]
            part[seen, :3], part[seen, 3] = pixels[:h_in, :w_in][seen], 255
        yield Frame(delay, disposal, transparent, left, top, pixels, canvas)
        if disposal == 2:
            part[:] = 0
        elif kept is not None:
            canvas = kept
        delay = disposal = 0
        transparent = None


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Opaque pixels by colour: four levels of red, green and blue each, BINS together."""
    c = canvas.reshape(-1, 4)
    if not c[:, 3].all():
        c = c[c[:, 3] > 0]
    return np.bincount((c[:, 0] >> 6 << 4) | (c[:, 1] >> 6 << 2) | c[:, 2] >> 6, minlength=BINS)


_ENCODED = "doc_id long, n_bytes long, media binary"
_FRAME = "index int, delay_cs int, disposal int, `left` int, top int, width int, height int, histogram array<long>"
_DECODED = f"doc_id long, n_bytes long, payload binary, media binary, frames array<struct<{_FRAME}>>"
_FRAMES = pa.list_(pa.struct([*((n, pa.int32()) for n in ("index", "delay_cs", "disposal", "left", "top", "width", "height")), ("histogram", pa.list_(pa.int64()))]))


def _encode(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = [t.encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
            media = [encode_gif(t + b" " * (WIDTH - len(t) if not t else -len(t) % WIDTH)) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _decode_one(media: bytes) -> tuple[bytes, list[dict]]:
    parts, frames = [], []
    for i, f in enumerate(decode_gif(media)):
        parts.append(f.pixels[..., 0].tobytes())
        h, w = f.pixels.shape[:2]
        frames.append({"index": i, "delay_cs": f.delay, "disposal": f.disposal, "left": f.left, "top": f.top, "width": w, "height": h, "histogram": histogram(f.canvas).tolist()})
    return b"".join(parts), frames


def _decode(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            media = part.column(2).to_pylist()
            payloads, frames = zip(*map(_decode_one, media), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(payloads, pa.binary()), pa.array(media, pa.binary()), pa.array(frames, _FRAMES)], names=["doc_id", "n_bytes", "payload", "media", "frames"])


def store_gif(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a GIF; n_bytes are those of the text without padding."""
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(_encode, _ENCODED)


def load_gif(stored: DataFrame) -> DataFrame:
    """The stored rows with payload (the samples) and frames (time, place and colour histogram of each)."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_decode, _DECODED)


def _digests(batches):
    """The digest columns and frames, so that payloads need not return to the JVM."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            doc_id, n_bytes, media = (batch.column(i).slice(at, 64) for i in range(3))
            rows = []
            for m in media:
                stored = m.as_py()
                payload, frames = _decode_one(stored)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), frames))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), _FRAMES)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([doc_id, n_bytes, *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames"])


def store_frames(stored: DataFrame) -> DataFrame:
    """Timed frames with their colour histograms, and digests of the samples, decoded from the stored GIFs and written."""
    ddl = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames array<struct<{_FRAME}>>"
    return written(stored.select("doc_id", "n_bytes", "media").mapInArrow(_digests, ddl), "frames")


def feature(frames: str = "frames") -> Column:
    """Number of frames, their time, and the filled bins of the sum of their histograms."""
    none = F.array_repeat(F.lit(0).cast("long"), BINS)
    total = F.aggregate(frames, none, lambda acc, f: F.zip_with(acc, f.histogram, lambda a, b: a + b))
    bins = F.filter(F.transform(total, lambda n, i: F.when(n > 0, F.concat_ws(":", i.cast("string"), n.cast("string")))), lambda x: x.isNotNull())
    time = F.aggregate(frames, F.lit(0).cast("long"), lambda acc, f: acc + f.delay_cs)
    return F.concat(F.lit("frames="), F.size(frames).cast("string"), F.lit(";cs="), time.cast("string"), F.lit(";rgb="), F.concat_ws(",", bins))


def op8_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(store_gif(table(spark, sf_dir, "documents")), "gif")
    return store_frames(stored).withColumn("feature", feature()).drop("frames")
