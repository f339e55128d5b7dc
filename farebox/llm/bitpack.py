"""Token ids in files of fixed-width packed bits.

A file (the payload of one row of the written table) holds the ids of whole documents, one after the other, in blocks
of BLOCK ids. Each id takes the minimum number of bits that the vocabulary needs; least significant bit first, blocks
padded to a byte. Layout, all little-endian: ``FBIT``, u8 bits, 3 zero bytes, u32 ids a block, u32 blocks, u64 ids, a
u64 offset for each block, the blocks. So any range of ids is read from its blocks alone, and unpacked by numpy.

Rows are in ascending doc_id order (null first; repeated ids by the hash of their text): the texts are dealt out by
range of doc_id, sorted within each task and encoded there. Spark's committed parquet writer stores the files, so a lost
executor leaves no half file. A document's place in the whole is its place in its shard (one writing task) plus the
ids of the shards before; only one number for each shard is summed up for that.

Edge cases: a null text is empty, so its ids are the end id alone; an empty table gives empty files; a file
exceeds FILE_IDS ids only by its last document, and a document isn't larger in memory than its text; repeated rows are written each;
other columns aren't read, whatever their names.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farebox.llm.common import new_path, table, text_or_empty
from farebox.llm.encode import encoder

BLOCK = 4096
FILE_IDS = 1 << 18
VOCABULARY = "byte_bpe_50k.json"
END = 2
_HEAD = struct.Struct("<4sB3xIIQ")
_FILES = "shard int, first long, docs array<long>, counts array<long>, payload binary"


def width(vocabulary: int) -> int:
    """The bits of the largest id."""
    return max(1, int(vocabulary - 1).bit_length())


def _pack_block(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each, bitorder="little").tobytes()


def _unpack_block(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.zeros((n, 32), np.uint8)
    each[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(each, axis=1, bitorder="little").view("<u4").ravel()


def pack(ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    if ids.size and int(ids.max()).bit_length() > bits:
        raise ValueError(f"an id needs more than {bits} bits")
    parts = [_pack_block(ids[i : i + block], bits) for i in range(0, ids.size, block)]
    head = _HEAD.size + 8 * len(parts)
    offsets = np.cumsum([head, *map(len, parts)])[:-1].astype("<u8")
    return b"".join((_HEAD.pack(b"FBIT", bits, block, len(parts), ids.size), offsets.tobytes(), *parts))


def unpack(data: bytes, start: int = 0, n: int | None = None) -> np.ndarray:
    """The n ids from start on (all of them, if n is None); only their blocks are read."""
    magic, bits, block, blocks, total = _HEAD.unpack_from(data)
    if magic != b"FBIT":
        raise ValueError("not a file of packed ids")
    n = total - start if n is None else n
    if not 0 <= start <= start + n <= total:
        raise IndexError(f"ids {start} to {start + n} of {total}")
    if not n:
        return np.empty(0, np.uint32)
    offsets = np.frombuffer(data, "<u8", blocks, _HEAD.size)
    first, last = start // block, (start + n - 1) // block
    got = [_unpack_block(data[(at := int(offsets[b])) : at + (k * bits + 7) // 8], k, bits) for b in range(first, last + 1) for k in [min(block, total - b * block)]]
    return np.concatenate(got)[start - first * block :][:n]


def _file_batch(shard: int, first: int, docs: list, ids: list[np.ndarray], bits: int) -> pa.RecordBatch:
    payload = pack(np.concatenate(ids), bits)
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(x) for x in ids]], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
        names=["shard", "first", "docs", "counts", "payload"],
    )


def write_ids(df: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of every text of df, each followed by the end id, to files under path."""

    def encode(batches):
        from pyspark import TaskContext

        shard, coder, first, total = TaskContext.get().partitionId(), encoder(vocabulary), 0, 0
        bits = width(max(coder.tokenizer.get_vocab_size(), end + 1))
        docs, ids, tail = [], [], np.array([end], np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                for d, got in zip(part.column(0).to_pylist(), coder.ids(part.column(1).to_pylist()), strict=True):
                    docs.append(d)
                    ids.append(np.concatenate([got, tail]))
                    total += got.size + 1
                    if total - first >= FILE_IDS:
                        yield _file_batch(shard, first, docs, ids, bits)
                        docs, ids, first = [], [], total
        if docs:
            yield _file_batch(shard, first, docs, ids, bits)

    rows = df.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    tie = F.xxhash64("text")
    rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie).mapInArrow(encode, _FILES).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    files = spark.read.schema(_FILES).parquet(path)

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard, at, docs, counts = (batch.column(c)[i].as_py() for c in range(4))
                raw = unpack(batch.column(4)[i].as_buffer().to_pybytes()).astype("<u4").tobytes()
                ends = np.cumsum(counts)
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array([shard] * len(docs), pa.int32()), pa.array(at + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "shard", "at", "n_tokens", "ids_crc32"],
                )

    docs = files.mapInArrow(decode, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long")
    shards = files.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op5_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path)
