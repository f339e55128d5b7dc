import random
import re
from collections import Counter

import pytest

from farebox.llm import mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 50, "é": 3}, {"a": 5}, {"a": 0, "b": 0}, {"a": 0, "b": 7, "c": 7}, {f"s{i}": i * i for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def documents(n=800):
    rng = random.Random(5)
    return [(i, "w " * min(3000, int(rng.paretovariate(1.1) * 10)), rng.choice(["src1", "src1", "src1", "b", "B", None, "é"])) for i in range(n)]


def check(rows, got):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = brute_targets(sizes)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


@pytest.mark.parametrize("arity", [64, 4])
def test_near_the_targets_and_the_same_again(spark, tmp_path, arity, monkeypatch):
    monkeypatch.setattr(mixing, "ARITY", arity)
    rows = [*documents(), (900, None, "b"), (901, "", "b"), (None, "x y z", "b"), *[(902, "same row here", "src1")] * 300]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op6_pivotal_mixing(spark, str(tmp_path)).collect()
    check(rows, got)
    again = mixing.op6_pivotal_mixing(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = Counter((r.doc_id, r.text) for r in mixing.mix(df).collect())
    words = Counter()
    for r in got:
        words[r.doc_id] += r.taken
    assert Counter({d: len((t or "").split()) * n for (d, t), n in mixed.items()}) == words


def test_each_document_has_its_probability(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "a" if i < 40 else "b", 1 + i % 7) for i in range(80)], "doc_id long, source string, size long")
    size = Counter()
    for i in range(80):
        size["a" if i < 40 else "b"] += 1 + i % 7
    want, share = brute_targets(size), Counter()
    for seed in range(12):
        monkeypatch.setattr(mixing, "SEED", seed)
        for r in mixing.decide(rows).collect():
            share[r.source] += (r.low + r.more) * r.size
    assert all(abs(share[s] / 12 - want[s]) < 3 for s in "ab")


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0


def test_mix_keeps_clashing_columns(spark):
    names = ["count", "low", "more", "_k", "_n", "_c", "key", "own", "of", "tie", "all", "turn", "n", "size"]
    rows = [(i // 2, f"one two three {'four ' * (i % 5)}", "ab"[i % 2], *([i] * len(names))) for i in range(120)] + [(7, "same", "a", *([1] * len(names)))] * 9
    df = spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'{c} int' for c in names)}")
    got = mixing.mix(df)
    assert got.columns == df.columns
    assert {tuple(r) for r in got.collect()} <= set(rows)
    assert got.count() == mixing.mix(df.select("doc_id", "text", "source")).count()


def test_texts_are_shuffled_once(spark):
    """Rows that agree and others go one way, so a text isn't shuffled for each of two."""
    df = spark.createDataFrame([(i // 3, f"text {'word ' * (i % 7)}", "ab"[i % 2]) for i in range(90)], "doc_id long, text string, source string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and any(c in line for c in ("key#", "own#", "of#"))]
    assert len(moved) == 2, moved  # the rows, and what is decided of them
