import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from farebox.llm import packing


def check(docs, sequences, window):
    """Every id in one piece, full windows but for powers of two."""
    seen = defaultdict(list)
    for pieces in sequences:
        total = sum(n for *_, n in pieces)
        assert 0 < total <= window and (total == window or total & total - 1 == 0)
        for doc, start, n in pieces:
            seen[doc].append((start, n))
    for doc, ids in enumerate(docs):
        at = 0
        for start, n in sorted(seen[doc]):
            assert start == at and n > 0
            at += n
        assert at == ids.size


@pytest.mark.parametrize("seed", range(5))
def test_shards(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, 300, int(n)).astype(np.uint32) for n in np.maximum(1, rng.pareto(1, 80 if seed else 1) * 20)]
    for window in (64, 4096):
        check(docs, packing.pack_shard(docs, window), window)


def test_scores_are_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 40, 12).astype(np.uint32) for _ in range(30)]
    index = packing.Shard(docs)
    mean = np.mean([d.size for d in docs])
    got = index.scores(4)
    for i, d in enumerate(docs):
        want = 0.0
        for t in set(docs[4].tolist()):
            df = sum(t in x for x in docs)
            tf = (d == t).sum()
            want += np.log(1 + (30 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d.size / mean))
        assert abs(want - got[i]) < 2e-3


def test_neighbours_share_windows():
    rng = np.random.default_rng(4)
    docs = [rng.integers(1000 * (i % 4), 1000 * (i % 4) + 200, 100).astype(np.uint32) for i in range(64)]
    alone = sum(len({d % 4 for d, *_ in s}) == 1 for s in packing.pack_shard(docs, 400))
    assert alone == 16


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 40)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(90).collect()]
    rows = [*docs, (5001, None), (5002, ""), (5003, "very long text " * 20_000), (None, "same"), (5004, "same"), (5004, "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, offset int").repartition(3)
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = {d: t.encode(x or "", add_special_tokens=False).ids + [2] for d, x in rows}
    pieces = packing.pack(df).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == want.keys()
    for d, ids in want.items():
        raw = np.array(ids, "<u4").tobytes()
        if d == 5004:
            raw *= 2
        own = sorted(by_doc[d], key=lambda p: p.start)
        assert d == 5004 or b"".join(bytes(p.ids) for p in own) == raw
        assert sum(p.length for p in own) * 4 == len(raw) and {p.doc_tokens for p in own} == {len(ids)}
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length * 4 == len(p.ids)
            at += p.length
        assert at == 4096 or at & at - 1 == 0
    got = {(r.doc_id, r.start, r.sequence_id, r.offset): r.ids_crc32 for r in packing.digest(packing.pack(df)).collect()}
    assert got == {(p.doc_id, p.start, p.sequence_id, p.offset): zlib.crc32(bytes(p.ids)) for p in pieces}
    assert packing.pack(df.limit(0)).count() == 0


def test_scores_of_matrix_and_postings_are_bm25():
    rng = np.random.default_rng(5)
    docs = [rng.zipf(1.5, 60).clip(max=200).astype(np.uint32) for _ in range(50)]
    terms, tfs = zip(*(np.unique(d, return_counts=True) for d in docs), strict=True)
    df = np.bincount(np.concatenate(terms))
    corpus = packing.Corpus(50, 60.0, df)
    columns = np.full(df.size, -1)
    columns[np.argsort(-df)[:10]] = np.arange(10)
    got = packing._Scored(corpus, columns, list(terms), list(tfs), np.full(50, 60)).scores([terms[3], terms[7]])
    for row, seed in zip(got, (3, 7), strict=True):
        want = [sum(corpus.weights(np.array([t]), np.array([(d == t).sum()]), np.array([60.0]))[0] for t in terms[seed] if t in d) for d in docs]
        assert np.abs(row - want).max() < 1e-2


def test_retrieval_covers_the_table_however_it_is_split(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 16)
    monkeypatch.setattr(packing, "SCORED", 30, raising=False)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"{'abcd'[i % 4]}{'efgh'[i % 4]}{k}" for k in rng.integers(0, 40, 100)) for i in range(160)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = []
    for n in (1, 5):
        windows = defaultdict(list)
        for p in packing.pack(df.repartition(n), window=1024).collect():
            windows[p.sequence_id].append((p.doc_id, p.start, p.length))
        got.append(sorted(sorted(w) for w in windows.values()))
        # each of the four kinds is met from the whole table: few windows are mixed
        assert sum(len({d % 4 for d, *_ in w}) == 1 for w in windows.values()) >= 0.75 * len(windows)
    assert got[0] == got[1]


def test_scores_take_all_shared_terms():
    # 200 shared terms of one weight in the seed: all of them count
    docs = [np.arange(200, dtype=np.uint32), np.arange(100, dtype=np.uint32), np.arange(100, 200, dtype=np.uint32)]
    got = packing.Shard(docs).scores(0)
    assert got[1] > 0 and abs(got[1] - got[2]) < 2e-3


def test_a_window_takes_a_text_once():
    rng = np.random.default_rng(9)
    texts = [rng.integers(0, 500, 90).astype(np.uint32) for _ in range(60)]
    docs = [t for t in texts for _ in range(2)]
    full, left = packing.fill_windows(docs, 400, None)
    twice = sum(len({d // 2 for d, *_ in w}) < len({d for d, *_ in w}) for w in full)
    assert len(full) >= 20 and twice <= 2
    # nothing else is left: then a text meets itself rather than padding
    check([texts[0]] * 30, packing.pack_shard([texts[0]] * 30, 400), 400)
