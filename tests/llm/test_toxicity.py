import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from farebox.llm import toxicity


@pytest.mark.parametrize("seed", range(4))
def test_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    vectors = []
    for _ in range(700):
        t = np.unique(rng.integers(0, 40, rng.integers(0, 6)))
        w = rng.random(t.size) + 0.1
        vectors.append((t, w / np.sqrt(w @ w) if t.size else w))
    vectors[10] = vectors[600] = vectors[3]
    index = toxicity.BlockMaxIndex(vectors, 40)
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 700, 7):
        if not vectors[i][0].size:
            continue
        cos = dense @ dense[i]
        cos[i] = 0
        found, got = index.nearest(*vectors[i], 15, without=i)
        want = np.sort(cos[cos > 1e-12])[::-1]
        want = want[want >= want[:15][-1] - 1e-9] if want.size else want
        assert np.allclose(got, want) and np.allclose(cos[found], got)


def test_blocks_are_left_out():
    rng = np.random.default_rng(8)
    vectors = []
    for i in range(1024):
        t = np.unique(np.concatenate([rng.integers(50 * (i % 16), 50 * (i % 16) + 50, 12), rng.integers(800, 1000, 5)]))
        w = np.where(t < 800, 1.0, 0.05) + rng.random(t.size) / 10
        vectors.append((t, w / np.sqrt(w @ w)))
    index = toxicity.BlockMaxIndex(vectors, 1000)
    for v in vectors:
        index.nearest(*v, 15)
    assert index.visited < 0.5 * 1024 * index.blocks


def test_scores_are_tf_idf_over_all_terms(spark):
    """Against full vectors, made without the index: nothing of a text is left out."""
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("documents", "labels"))
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs.select("doc_id", "text"), labels).collect()}
    texts = {r.doc_id: toxicity.terms_of(r.text) for r in docs.collect()}
    known = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    names = sorted(i for i in known if i in texts)
    df = Counter(t for c in texts.values() for t in c)
    n, own = len(names), Counter(known[i] for i in names)
    in_examples = {t for i in names for t in texts[i]}
    met = {t: [sum(t in texts[i] for i in names if known[i] == k) for k in (0, 1)] for t in in_examples}
    chi2 = {t: n * (a * (own[0] - b) - b * (own[1] - a)) ** 2 / max(own[0] * own[1] * (a + b) * (n - a - b), 1e-9) for t, (b, a) in met.items()}
    top = max(chi2.values())

    def vector(counts):
        total = sum(counts.values())
        idf = lambda x: np.log((1 + len(texts)) / (1 + x)) + 1
        w = {t: np.sqrt(c / total) * (idf(df[t]) * max(0.01, np.sqrt(chi2[t] / top)) if t in chi2 else 0.01 * idf(1)) for t, c in counts.items()}
        length = np.sqrt(sum(x * x for x in w.values()))
        return {t: x / length for t, x in w.items()}

    examples = {i: vector(texts[i]) for i in names}
    for i, c in texts.items():
        v = vector(c) if c else {}
        cosines = sorted((sum(x * e.get(t, 0.0) for t, x in v.items() if t in in_examples) for e in examples.values()), reverse=True)
        want = [x for x in cosines[:15] if x > 1e-12]
        assert np.allclose([e.cosine for e in got[i].evidence], want)
        assert bool(got[i].evidence) == any(t in in_examples for t in c)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in toxicity.op7_nearest_toxicity(spark, d).collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    met = Counter((labels[r.doc_id], r.predicted) for r in rows if r.held_out)
    print(met)
    assert met[1, 1] / (met[1, 1] + met[1, 0]) > 0.88 and met[0, 0] / (met[0, 0] + met[0, 1]) > 0.97


def test_rows(spark):
    bad, good = "you worthless idiot text", "a plain and quiet text"
    texts = [(i, f"{bad} {i % 7}" if i % 3 == 0 else f"{good} {i % 5}", 1) for i in range(300)]
    docs = spark.createDataFrame([*texts, (1000, None, 1), (1001, "", 1), (None, bad, 1), (1003, "worthless " * 90_000, 1), (5, good, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 305
    assert all((r.toxicity.score >= 0.5) == ("idiot" in (r.text or "")) for r in got if r.doc_id != 1003) and all(0 <= r.toxicity.score <= 1 for r in got)
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    assert all(len(r.toxicity.evidence) == 15 for r in got if "idiot" in (r.text or ""))
    assert {r.toxicity.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(i, "you worthless idiot" if i % 2 else "a quiet text", i) for i in range(60)], "doc_id long, text string, _toxicity long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and all(r._toxicity == r.doc_id and r.doc_id % 2 == 0 for r in kept.collect())


def test_driver_holds_numbers_of_terms(spark):
    """The driver's Python holds the examples' terms as numbers while it fits, not as counters of strings."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    tracemalloc.start()
    try:
        model = toxicity.fit(docs.select("doc_id", "text"), labels)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    print(peak, len(model.names), len(model.vocabulary))
    assert len(model.names) > 1000 and peak < 62
