"""Tolerant measures, tails, model tests and parameter settings against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from farebox.functions import special, tolerant
from farebox.operators import choice, modeltests, settings


def metres(x, y):
    h = math.sin(math.radians(y[1] - x[1]) / 2) ** 2 + math.cos(math.radians(x[1])) * math.cos(math.radians(y[1])) * math.sin(math.radians(y[2] - x[2]) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(math.sqrt(h))


def plain(a, b, score, leave):
    """The last cell of a table: best sum of scores (leave None), or the least cost."""
    t = [[0.0 if leave is None else (i + j) * leave for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            s = t[i - 1][j - 1] + score(x, y)
            t[i][j] = max(t[i - 1][j], t[i][j - 1], s) if leave is None else min(t[i - 1][j] + leave, t[i][j - 1] + leave, s)
    return t[-1][-1]


def test_tolerant_measures_of_long_and_empty_sequences(spark):
    rng = random.Random(4)
    stop = lambda: (rng.randrange(40), 37.5 + rng.random() * 0.004, 127.0 + rng.random() * 0.004)
    places = {i: stop()[1:] for i in range(40)}
    sequence = lambda n: [(i, *places[i]) for i in (rng.randrange(40) for _ in range(n))]
    modes = lambda n: [rng.choice(["BUS", "SUBWAY", "RAIL", "FERRY", None]) for _ in range(n)]
    rows = [(k, sequence(m), sequence(n), modes(m), modes(n)) for k, (m, n) in enumerate([(0, 0), (0, 3), (3, 0), (1, 1), (5, 9), (90, 70), (12, 12)])]
    place = "array<struct<id:long,lat:double,lon:double>>"
    df = spark.createDataFrame([*rows, (99, None, [], None, [])], f"k int, a {place}, b {place}, m array<string>, n array<string>")
    got = {r.k: r for r in df.select("k", tolerant.tolerant_similarity(F.col("a"), F.col("b")).alias("s"), tolerant.mode_similarity(F.col("m"), F.col("n")).alias("t")).collect()}
    near = lambda x, y: 1.0 if x[0] == y[0] else max(0.0, 1 - metres(x, y) / 300)
    cost = lambda x, y: 0.0 if x == y else tolerant.MODE_COSTS.get((x, y), tolerant.MODE_COSTS.get((y, x), 1.0))
    for k, a, b, m, n in rows:
        want = 1.0 if not a and not b else 0.0 if not a or not b else 2 * plain(a, b, near, None) / (len(a) + len(b))
        assert got[k].s == pytest.approx(want, abs=1e-9)
        assert got[k].t == pytest.approx(1.0 if not m and not n else 1 - plain(m, n, cost, 1.0) / max(len(m), len(n)), abs=1e-9)
    assert got[99].s is None and got[99].t is None


def test_chi_square_tails(spark):
    cases = [(x, k) for k in (1, 2, 3, 4, 7, 10, 31, 100) for x in (0.0, 1e-6, 0.3, 1.0, k * 0.5, float(k), k * 1.5, k * 3.0, 250.0)]
    df = spark.createDataFrame([(i, x, k) for i, (x, k) in enumerate(cases)] + [(900, None, 3), (901, 1.0, 0), (902, -4.0, 2)], "i int, x double, k int")
    got = {r.i: r.p for r in df.select("i", special.chi2_tail(F.col("x"), F.col("k")).alias("p")).collect()}

    def tail(x, k):  # closed forms, from two and one degrees of freedom up
        y = x / 2
        if k % 2 == 0:
            return math.exp(-y) * math.fsum(math.exp(i * math.log(y) - math.lgamma(i + 1)) if y else float(i == 0) for i in range(k // 2))
        return math.erfc(math.sqrt(y)) + (math.exp(-y) * math.fsum(math.exp((i - 0.5) * math.log(y) - math.lgamma(i + 0.5)) for i in range(1, (k + 1) // 2)) if y else 0.0)

    for i, (x, k) in enumerate(cases):
        assert got[i] == pytest.approx(tail(x, k), rel=1e-7, abs=1e-12), (x, k)
    assert got[900] is None and got[901] is None and got[902] == 1.0


def test_nested_tests_against_a_plain_fit(spark):
    rng, rows = np.random.default_rng(8), []
    for c in range(300):
        x = rng.normal(size=(4, 3))
        v = x @ np.array([0.8, -0.5, 0.0]) + rng.gumbel(size=4)
        rows += [(c, i, int(i == v.argmax()), *map(float, x[i])) for i in range(4)]
    df = spark.createDataFrame(rows, "chain_id long, alt_id long, choice int, x double, y double, z double")

    def fit(chains, names):
        b = np.zeros(len(names))
        for _ in range(30):
            g, h, ll = np.zeros(len(names)), np.zeros((len(names),) * 2), 0.0
            for own in chains:
                a = np.array([[r[3 + "xyz".index(n)] for n in names] for r in own])
                e = np.exp(a @ b)
                p = e / e.sum()
                k = [r[2] for r in own].index(1)
                m = p @ a
                g, h, ll = g + a[k] - m, h - (a.T * p) @ a + np.outer(m, m), ll + math.log(p[k])
            b = b - np.linalg.solve(h, g)
        return b, np.linalg.inv(-h), ll

    chains = [rows[i : i + 4] for i in range(0, len(rows), 4)]
    fewer = [[r for r in own if r[1] != 3] for own in chains if own[3][2] == 0]
    full, short, less = fit(chains, "xyz"), fit(chains, "x"), fit(fewer, "xyz")
    got = {r.test: r for r in modeltests.nested_tests(spark, df, ["x", "y", "z"], ["y", "z"], F.col("alt_id") == 3).collect()}
    assert got["likelihood_ratio"].statistic == pytest.approx(2 * (full[2] - short[2]), rel=1e-6) and got["likelihood_ratio"].dof == 2
    assert got["likelihood_ratio"].p == pytest.approx(math.exp(-(full[2] - short[2])), rel=1e-6)
    assert got["wald"].statistic == pytest.approx(full[0][1:] @ np.linalg.inv(full[1][1:, 1:]) @ full[0][1:], rel=1e-6)
    gap = less[0] - full[0]
    assert got["hausman"].statistic == pytest.approx(gap @ np.linalg.inv(less[1] - full[1]) @ gap, rel=1e-4) and got["hausman"].dof == 3
    assert choice.fit_logit(df, ["x"])["x"]["beta"] == pytest.approx(short[0][0], abs=1e-6)


def test_association_of_one_category(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None)], "a string, b string")
    assert tuple(modeltests.association(df, "a", "b").first()) == (0.0, 0, 1.0, 0.0)
    both = spark.createDataFrame([("a", None)] * 9 + [(None, "y")] * 9, "a string, b string")
    found = modeltests.association(both, "a", "b").first()
    assert found.chi2 == pytest.approx(18) and found.dof == 1 and found.cramers_v == pytest.approx(1) and found.p == pytest.approx(math.erfc(3), rel=1e-6)


def test_settings_pick_for_themselves(spark, monkeypatch):
    monkeypatch.setattr(settings, "TOGETHER", 2)
    rows = [(1, 0, 0.5, 0, 1.0, 9.0), (1, 1, 0.9, 1, 4.0, 2.0), (2, 0, 0.1, 0, None, 1.0), (2, 1, 0.2, 0, 3.0, 3.0), (3, 0, 0.7, 1, None, None)]
    df = spark.createDataFrame(rows, "chain_id long, alt_id long, sim double, exact int, ride double, walk double")
    weights = spark.createDataFrame([(1, 3.0)], "chain_id long, weight double")
    got = settings.objectives_by_setting(df, [{"ride": 1.0}, {"walk": 1.0}, {"ride": 1.0, "walk": 1.0}], ["ride", "walk"], weights)
    want = [(0, 2, (0.5 * 3 + 0.2) / 4, 0.0, (3 + 3) / 4), (1, 2, (0.9 * 3 + 0.2) / 4, 0.75, (6 + 3) / 4), (2, 2, (0.9 * 3 + 0.2) / 4, 0.75, (18 + 6) / 4)]
    assert [tuple(map(lambda v: pytest.approx(v), w)) == tuple(r) for r, w in zip(got.orderBy("setting").collect(), want, strict=True)] == [True] * 3


def test_settings_scan_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr("l_orderkey chain_id", "l_linenumber alt_id", "l_tax sim", "1 exact", "l_quantity ride")
    plan = settings.objectives_by_setting(df, [{"ride": float(i)} for i in range(22)], ["ride"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_quantiles_of_groups_with_repeats(spark, monkeypatch):
    from farebox.operators import quantiles

    rng = random.Random(6)
    rows = [("a", float(rng.randrange(500))) for _ in range(2000)] + [("b", 7.0)] * 300 + [("c", 1.0), ("c", 2.0), (None, 5.0), ("d", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for many in (0, 10_000):
        monkeypatch.setattr(quantiles, "MANY", many)
        got = {r.g: r for r in quantiles.quantiles(df, ["g"], "v", {"low": 0.25, "high": 0.9}).collect()}
        assert got.keys() == {"a", "b", "c", None}
        for g, r in got.items():
            own = [v for k, v in rows if k == g and v is not None]
            assert r.n == len(own) and (r.low, r.high) == (pytest.approx(np.quantile(own, 0.25)), pytest.approx(np.quantile(own, 0.9)))
    assert [tuple(r) for r in quantiles.values_at(df, [], "v", {"x": lambda n: n - 1, "y": lambda n: n}).collect()] == [(2303, 499.0, None)] or max(v for _, v in rows if v) == 499.0
    assert quantiles.quantiles(df.limit(0), ["g"], "v", {"q": 0.5}).collect() == []
