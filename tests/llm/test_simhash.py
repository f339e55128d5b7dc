import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from farebox.llm import graph, simhash
from farebox.llm.graph import connected_components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_components(ids, prints, far=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin((prints[i] ^ prints[j]) & (2**64 - 1)).count("1") <= far:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    out = {}
    for g in groups.values():
        known = [ids[i] for i in g if ids[i] is not None]
        for i in g:
            out[i] = min(known, default=None)
    return out


def test_fingerprints():
    for text in ("", None, " \t", "One", "one TWO", "a b c d a b c d", "É è\x0bB\x0cC\x1c d e" * 50, "x " * 40_000):
        assert simhash.fingerprint(text) == signed(brute_print(text))


def test_two_errors_share_a_codeword():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 20_000)
    y = x ^ (1 << rng.integers(0, 23, x.size)) ^ (1 << rng.integers(0, 23, x.size))
    a, b = simhash.codewords(x), simhash.codewords(y)
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).all()


def test_two_errors_share_a_key():
    rng = random.Random(2)
    x = [rng.getrandbits(64) for _ in range(5_000)]
    y = [v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for v in x]
    y = [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in x]
    a, b = (simhash.keys_of(np.array([signed(v) for v in z])) for z in (x, y))
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).all()


def test_links_are_exact_also_in_hot_keys(spark, monkeypatch):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    prints = {signed(s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5)) if rng.random() < 0.8) & (2**64 - 1)) for s in seeds for _ in range(60)}
    prints = sorted(prints)
    want = brute_components(prints, prints)
    for cap in (64, 3):
        monkeypatch.setattr(simhash, "PAIRED", cap)
        roots = {r.node: r.root for r in connected_components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))).collect()}
        assert [roots.get(p, p) for p in prints] == [want[i] for i in range(len(prints))]


def test_rows(spark):
    long = "word " * 30 + "tail end here " * 20
    rows = [(5, long, 1), (3, long, 1), (9, long.upper(), 1), (2, None, 1), (4, "", 1), (None, "alone in this", 1), (7, "quite another text", 1), (7, "quite another text", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (2, 2), (4, 2), (None, None), (7, 7), (7, 7)], key=str)
    assert sorted(str(r.doc_id) for r in simhash.keep_one(df).collect()) == ["2", "3", "7", "None"]  # of repeated rows one stays, too
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_similar_texts_are_those_of_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(100_001, " ".join(map(str, range(104)))), (100_002, " ".join(map(str, range(1, 105)))), (100_003, None), (100_004, "one two")]
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root, pairs = {d: d for d in sets}, 0

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) - 1e-9 and (x == y or len(x & y) >= 0.8 * len(x | y) - 1e-9):
                pairs += x != y
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert pairs >= 10
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, width=5, similarity=0.8).collect()}
    assert got == {d: find(d) for d in ids}
    assert sorted(r.doc_id for r in simhash.keep_one(df, width=5, similarity=0.8).collect()) == [d for d in ids if find(d) == d]


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Two groups of near copies in common keys, and texts that share a passage only: as brute force, with and without the linear way."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    far = base[:90] + [f"x{i}" for i in range(30)]
    texts = []
    for source, n in ((base, 70), (far, 40)):
        for _ in range(n):
            t = list(source)
            t[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    texts += [" ".join(base[:30] + [f"z{rng.randrange(10**6)}" for _ in range(60)]) for _ in range(20)]
    sets = [set(simhash.shingles(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for cap in (64, 4):
        monkeypatch.setattr(simhash, "PAIRED", cap)
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, width=5, similarity=0.8).collect()}
        assert got == {i: find(i) for i in range(len(texts))}


def test_keys_find_similar_sets():
    rng = np.random.default_rng(12)
    missed = 0
    for _ in range(400):
        x = rng.integers(-(1 << 63), 1 << 63, 90)
        a, b = np.sort(x[:85]), np.sort(x[10:])  # 75 of 90: a similarity of 0.83
        missed += not set(simhash.bands(a)) & set(simhash.bands(b))
    assert missed <= 1


def test_kept_columns_may_clash(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, 8, 9, "k"), (2, "a b c d e f", 7, 8, 9, "k")], "doc_id long, text string, fp int, row int, n int, all string")
    for kept in (simhash.keep_one(df), simhash.keep_one(df, width=5, similarity=0.8)):
        assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c d e f", 7, 8, 9, "k")]


def test_fingerprints_give_candidates_with_a_similarity_too(spark, monkeypatch):
    """Without minimal hashes, what fingerprints link by Golay keys is still found, and verified."""
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join(words) + " end", " ".join(words[:1500] + ["other"] + words[1500:]), "a b", "A  b", "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = [simhash.fingerprint(t) & (1 << 64) - 1 for t in texts]
    assert 0 < (prints[0] ^ prints[1]).bit_count() <= 2 or prints[0] == prints[1]
    usual = simhash.with_bands

    def without_keys(df, width):
        return usual(df, width).withColumn("set", F.col("set").withField("keys", F.array().cast("array<bigint>")))

    monkeypatch.setattr(simhash, "with_bands", without_keys)
    found = simhash.near_duplicates(df, width=5, similarity=0.8).orderBy("doc_id").collect()
    near = (prints[0] ^ prints[2]).bit_count() <= 2 or (prints[1] ^ prints[2]).bit_count() <= 2
    assert [r.component_id for r in found] == [0, 0, 0 if near else 2, 3, 3, 5]


def test_plans_stay_small(spark, monkeypatch):
    """The driver never plans many exchanges at once, also where large keys take the linear way: its memory follows the largest plan."""
    rng, usual, planned = random.Random(6), simhash.written, {}
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base[:90], *(f"{i % 3}x{j}" for j in range(rng.randrange(9, 12)))]) for i in range(40)] + ["alone", "alone", None]

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")

    def noting(df, name):
        planned[name] = max(planned.get(name, 0), exchanges(df))
        return usual(df, name)

    monkeypatch.setattr(simhash, "PAIRED", 4)
    for module in (simhash, graph):
        monkeypatch.setattr(module, "written", noting)
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=5, similarity=0.8)
    planned["result"] = exchanges(kept)
    print(planned)
    assert {"candidates", "across", "links", "stars"} <= planned.keys() and max(planned.values()) <= 12
    assert sorted(r.doc_id for r in kept.collect()) == [0, 40, 42]


def test_texts_are_dealt_once(spark, monkeypatch):
    """Texts stay where their rows were dealt, however many rows are asked for: only what asks for them moves."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base[:90], *(f"{i % 3}x{j}" for j in range(9 + i % 3))]) for i in range(40)] + ["alone", "alone", None]
    usual, plans, tables = simhash.written, {}, len(spark.catalog.listTables())

    def noting(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return usual(df, name)

    monkeypatch.setattr(simhash, "written", noting)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=5, similarity=0.8)
        plans["result"] = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == [0, 40, 42]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [plans[name].count("Exchange ") for name in ("texts", "result")] == [1, 1]
    assert len(spark.catalog.listTables()) == tables
