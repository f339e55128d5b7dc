import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from farebox.llm import bitpack


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 20, 32])
def test_round_trip_and_random_access(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 99, 100, 101, 1234):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = bitpack.pack(ids, bits, 100)
        assert (bitpack.unpack(data) == ids).all()
        assert len(data) <= n * bits / 8 + 24 + 9 * (n // 100 + 1)
        for a, k in ((0, 0), (0, n), (n // 2, n // 3), (max(n - 1, 0), min(n, 1))):
            assert (bitpack.unpack(data, a, k) == ids[a : a + k]).all()
    with pytest.raises(ValueError):
        bitpack.pack(np.array([1 << bits], np.uint64), bits)
    with pytest.raises(IndexError):
        bitpack.unpack(data, 1234, 1)


def test_width():
    assert [bitpack.width(v) for v in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


def brute(rows):
    t = Tokenizer.from_file(public_tokenizers.path(bitpack.VOCABULARY))
    out, at = [], 0
    for d, text in sorted(rows, key=lambda r: r[0]):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bitpack, "FILE_IDS", 300)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows = [*docs, (10_001, None), (10_002, ""), (-5, "very long " * 30_000), (10_003, " \n")]
    df = spark.createDataFrame([(*r, 1) for r in rows[::-1]], "doc_id long, text string, start int")
    bitpack.write_ids(df.repartition(5), str(tmp_path / "a"))
    got = sorted(map(tuple, bitpack.read_ids(spark, str(tmp_path / "a")).collect()))
    assert got == brute(rows)
    bitpack.write_ids(df.limit(0), str(tmp_path / "b"))
    assert bitpack.read_ids(spark, str(tmp_path / "b")).count() == 0


def test_repeated_and_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, "same"), (1, "same"), (None, "x y"), (1, "other")], "doc_id long, text string")
    bitpack.write_ids(df, str(tmp_path / "a"))
    got = sorted(bitpack.read_ids(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert got[0].doc_id is None and [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
