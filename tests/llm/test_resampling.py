import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from farebox.llm import resampling as rs
from farebox.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs(words, longest=2):
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def expected(texts, targets, least_words=20, share=25):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own = Counter(bucket(f) for _, t in texts for f in runs(words_of(t)))
    aim = Counter(bucket(f) for t in targets for f in runs(words_of(t)))
    s, t = sum(own.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + 10_000) / ((own[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    out, drawn = {}, []
    for d, text in texts:
        w = words_of(text)
        found = runs(w)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[d] = [len(found), weight, score, None]
        if len(w) >= least_words:
            drawn.append((-score, d))
    for k, (_, d) in enumerate(sorted(drawn)[: len(drawn) * share // 100], 1):
        out[d][3] = k
    return {d: tuple(x) for d, x in out.items()}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_equals_plain_computation(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    targets = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = QUERIES["op13_crc_resampling"](spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()} == expected(texts, targets)


@given(st.lists(st.binary(max_size=40), min_size=1, max_size=20), st.lists(st.binary(max_size=300), min_size=1, max_size=20))
def test_combined_crcs_are_those_of_the_whole(left, right):
    pairs = [(a, b) for a in left for b in right]
    crcs = lambda parts: np.array([zlib.crc32(p) for p in parts], np.uint32)
    got = rs.Shifts().combined(crcs([a for a, _ in pairs]), crcs([b for _, b in pairs]), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_shift_by_a_large_power():
    zeros = b"\0" * ((1 << 20) + 3)
    assert rs.Shifts().combined(np.array([zlib.crc32(b"ab")], np.uint32), np.array([zlib.crc32(zeros)], np.uint32), np.array([len(zeros)]))[0] == zlib.crc32(b"ab" + zeros)


@pytest.mark.parametrize("window", [8, 1 << 20])
def test_features_of_any_length(monkeypatch, window):
    monkeypatch.setattr(rs, "WINDOW", window)
    texts = ["", "Über uns, the THE 1st\x00x", "ÀÉ a b c d", "", ",;", "z" * 5000 + " q", "KK"]
    got = Counter()
    for first, n, found, of in rs.features(pa.array(["skipped", *texts])[1:], 4, 1 << 32):
        got.update((first + o, int(f)) for o, f in zip(of.tolist(), found.tolist(), strict=True))
        assert n.tolist() == [len(words_of(t)) for t in texts[first : first + n.size]]
    assert got == Counter((k, zlib.crc32(f.encode())) for k, t in enumerate(texts) for f in runs(words_of(t), 4))


def test_odd_rows_ties_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(20))
    rows = [(1, long, 5), (1, long, 5), (2, long + " x", 6), (3, None, 7), (4, "", 8), (None, long, 9), (5, "ab " * 50_000, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    target = spark.createDataFrame([(1, "w1 w2"), (2, None)], "item_id long, text string")
    got = rs.resample(docs, target, share=60).collect()
    assert len(got) == 7 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    want = expected([(d if d is not None else "", t) for d, t, _ in rows], ["w1 w2", None], share=60)
    assert all((r.n_features, r.weight, r.score) == want[r.doc_id if r.doc_id is not None else ""][:3] for r in got)
    best = sorted((-r.score, r.doc_id is not None, r.doc_id or 0) for r in got if r.n_words >= 20)[:3]
    assert sorted((-r.score, r.doc_id is not None, r.doc_id or 0) for r in got if r["rank"]) == best
    assert [r.n_features for r in got if r.doc_id in (3, 4)] == [0, 0]


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert rs.resample(docs, target).collect() == []
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.n_features for r in rs.resample(some, target).collect()] == [3]
