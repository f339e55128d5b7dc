"""Operators against plain computations of the same."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from farebox.functions import arrays, geo, times
from farebox.operators import calibration, choice, cleaning, latent, matching, sampling, spatial, street
from farebox.operators import timetable as tt


def logit_rows(seed, chains=600, classes=None):
    rng, rows = np.random.default_rng(seed), []
    for c in range(chains):
        n, z = int(rng.integers(2, 6)), float(rng.random() < 0.5)
        x = rng.normal(size=(n, 2))
        k = 0 if classes is None or rng.random() < 1 / (1 + math.exp(-(-1.5 + 3 * z))) else 1
        v = x @ np.array((classes or [[-0.8, 0.5]])[k])
        p = np.exp(v - v.max())
        pick = rng.choice(n, p=p / p.sum())
        rows += [(c, a, int(a == pick), float(x[a, 0]), float(x[a, 1]), z) for a in range(n)]
    return rows


DDL = "chain_id long, alt_id int, choice int, x double, y double, z double"


def test_logit_fit_has_the_largest_likelihood(spark):
    rows = logit_rows(1)
    got = choice.fit_logit(spark.createDataFrame(rows, DDL), ["x", "y"])

    def ll(b):
        out = 0.0
        for _, chain in itertools.groupby(rows, key=lambda r: r[0]):
            chain = list(chain)
            v = np.array([r[3] * b[0] + r[4] * b[1] for r in chain])
            out += v[[r[2] for r in chain].index(1)] - np.log(np.exp(v - v.max()).sum()) - v.max()
        return out

    b = np.array([got["x"]["beta"], got["y"]["beta"]])
    assert abs(b[0] + 0.8) < 0.3 and abs(b[1] - 0.5) < 0.3
    e = 1e-3
    for d in np.eye(2):
        assert ll(b) >= ll(b + e * d) and ll(b) >= ll(b - e * d)
        assert abs(ll(b + e * d) - ll(b - e * d)) / (2 * e) < 1e-2
    assert got["x"]["p"] < 0.01 and got["x"]["t"] == pytest.approx(got["x"]["beta"] / got["x"]["se"])
    with pytest.raises(RuntimeError, match="no convergence"):
        choice.fit_logit(spark.createDataFrame(rows, DDL), ["x", "y"], rounds=1)


def test_latent_classes_are_found(spark):
    df = spark.createDataFrame(logit_rows(2, 800, [[-3.0, 0.0], [0.0, 3.0]]), DDL).repartition(4, "chain_id").cache()
    got = latent.fit(df, ["x", "y"], ["z"], 2, starts=1, rounds=60)
    one = latent.fit(df, ["x", "y"], ["z"], 1, starts=1, rounds=60)
    assert got["converged"] and got["bic"] < one["bic"] - 50
    first, second = sorted(got["betas"])
    assert first[0] < -2 and abs(first[1]) < 0.8 and second[1] > 2 and abs(second[0]) < 0.8
    mixed = latent.with_mixture(df, ["x", "y"], got["betas"], ["z"], got["classes"])
    assert mixed.where("choice = 1").agg(F.sum(F.log("p"))).first()[0] == pytest.approx(got["ll"], abs=1e-3)
    assert got["starts"] == [{"ll": got["ll"], "converged": True}]
    # the gradient of every set is that of its likelihood, in one pass
    rows = latent.packed(df, ["x", "y"], ["z"])
    at, e = np.array([0.3, -0.2, 0.1, 0.4, 0.2, -0.3]), 1e-4
    ll, g = latent.evaluate(rows, ["x", "y"], ["z"], 2, np.concatenate([[at], at + e * np.eye(6), at - e * np.eye(6)]))
    assert (ll[1:7] - ll[7:]) / (2 * e) == pytest.approx(g[0], abs=1e-2)
    mixed = latent.with_mixture(df, ["x", "y"], [[0.3, -0.2], [0.1, 0.4]], ["z"], [[0.2, -0.3]])
    assert mixed.where("choice = 1").agg(F.sum(F.log("p"))).first()[0] == pytest.approx(ll[0], abs=1e-6)


def test_latent_starts_report_themselves(spark):
    df = spark.createDataFrame(logit_rows(3, 300, [[-2.0, 0.0], [0.0, 2.0]]), DDL)
    got = latent.fit(df, ["x", "y"], ["z"], 2, starts=3, rounds=3)
    assert len(got["starts"]) == 3 and not got["converged"] and got["ll"] == max(s["ll"] for s in got["starts"])


def test_paths_of_any_number_of_edges_and_far_north(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    line = spark.createDataFrame([(i, i + 1, 1.0) for i in range(80)], "src long, dst long, cost double")
    assert spatial.shortest_paths(line, spark.createDataFrame([(0,)], "source long"), 500.0).count() == 81
    a = spark.createDataFrame([(1, 75.0, 10.0), (2, 10.0, 179.999)], "id long, lat double, lon double")
    b = spark.createDataFrame([(1, 75.0, 10.033), (2, 10.0, -179.999)], "id long, lat double, lon double")
    assert {(r.id, r.other) for r in spatial.within(a, b, 1000.0, max_lat=80.0).collect()} == {(1, 1), (2, 2)}
    with pytest.raises(Exception, match="beyond"):
        spatial.within(a, b, 1000.0).collect()


def test_walks_and_access(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    step = 0.001
    nodes = spark.createDataFrame([(i, 37.0 + step * i, 127.0) for i in range(6)], "id long, lat double, lon double")
    ways = spark.createDataFrame(
        [(1, [0, 1, 2, 3], {"highway": "footway"}), (2, [3, 4], {"highway": "motorway"}), (3, [4, 5], {"highway": "steps", "oneway": "yes"}), (4, [0, 99], {"highway": "path"}), (5, [3, 5], {"highway": "path", "access": "private"})],
        "way long, nodes array<long>, tags map<string,string>",
    )
    net = street.edges(ways, street.needed_nodes(ways, nodes))
    assert {(r.src, r.dst) for r in net.collect()} == {(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2), (4, 5)}
    one = 6_371_000 * math.radians(step)
    pairs = spark.createDataFrame([(1, 37.0 - step / 4, 127.0, 37.0 + 3.25 * step, 127.0), (2, 37.0, 127.0, 37.0 + 5 * step, 127.0)], "pair long, lat double, lon double, to_lat double, to_lon double")
    got = {r.pair: r.metres for r in street.walks(pairs, nodes, net).collect()}
    assert got.keys() == {1} and got[1] == pytest.approx(3.5 * one, rel=1e-6)
    places = spark.createDataFrame([(7, 37.0, 127.0), (8, 37.3, 127.0)], "id long, lat double, lon double")
    stops = spark.createDataFrame([(1, 37.0 + 2 * step, 127.0), (2, 37.0 + 4 * step, 127.0), (3, 37.0, 127.0001), (4, 37.3 + step, 127.0)], "id long, lat double, lon double")
    legs = {(r.id, r.stop): r.metres for r in street.access_legs(places, stops, nodes, net).collect()}
    assert legs[7, 1] == pytest.approx(2 * one, rel=1e-6) and legs[7, 2] == pytest.approx(4 * one * 1.3, rel=1e-6)
    assert legs[7, 3] == pytest.approx(one / 10 * math.cos(math.radians(37)), rel=1e-3) and legs[8, 4] == pytest.approx(1.3 * one, rel=1e-6)


def test_polylines_and_texts(spark):
    row = spark.range(1).select(
        geo.polyline(F.lit(38.5), F.lit(-120.2), F.lit(40.7), F.lit(-120.95)).alias("p"), times.duration_text(F.lit(-5)).alias("d"), geo.to_seconds(F.lit("1.26")).alias("s"), geo.to_seconds(F.lit("x")).alias("n"),
        arrays.rail_as_subway(F.array(F.lit("RAIL"), F.lit("BUS"))).alias("m"), geo.flat_distance(F.lit(37.0), F.lit(127.0), F.lit(37.001), F.lit(127.0)).alias("f"), geo.walk_minutes(F.lit(73)).alias("w"), geo.in_korea(F.lit(37.5), F.lit(127.0)).alias("k"),
        arrays.bus_only(F.array(F.lit("BUS"))).alias("b"), arrays.lcs_ratio(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))).alias("l"), arrays.boardable(F.lit(1), F.array(F.lit(1), F.lit(2)), F.lit(0)).alias("o"), arrays.alightable(F.lit(1), F.lit(1)).alias("a"),
    ).first()
    assert row.p == "_p~iF~ps|U_ulLnnqC" and row.d == "-" and row.s == 75 and row.n is None and row.m == ["SUBWAY", "BUS"]
    assert row.f == pytest.approx(111.0) and row.w == 2 and row.k and row.b == 1 and row.l == 0.5 and not row.o and not row.a


def test_translation_keeps_order_and_takes_the_last_entry(spark):
    pairs = spark.createDataFrame([(1, 10, 1), (2, 20, 3), (2, 19, 2), (None, 5, 4), (3, None, 5)], "a long, b long, place int")
    rows = [(1, [1, 2, 3, 1], [9, 2], "x"), (2, [], None, "y"), (3, None, [None, 1], "z")]
    df = spark.createDataFrame(rows, "e long, a array<long>, value array<long>, _key string")
    got = matching.with_translated(df, pairs, "a", "b", "a", "value", by="e", order="place")
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, [10, 20, 10], [20], "x"), (2, [], None, "y"), (3, None, [10], "z")]
    assert matching.with_translated(df.limit(0), pairs, "a", "b", "a", by="e").collect() == []


def test_translation_with_a_large_dictionary(spark):
    """A million entries, joined without a map: the time is that of a join."""
    pairs = spark.range(1_000_000).select(F.col("id").alias("a"), (F.col("id") * 3).alias("b"))
    df = spark.range(20_000).select(F.col("id").alias("chain"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.pmod(F.col("id") * 7919 + i * 104_729, F.lit(1_100_000))).alias("x"))
    got = matching.with_translated(df, pairs, "a", "b", "x", by="chain")
    want = df.select("chain", F.transform(F.filter("x", lambda v: v < 1_000_000), lambda v: v * 3).alias("x"))
    assert got.exceptAll(want).count() == 0 and got.count() == 20_000


def test_as_of_over_slices(spark):
    rng = np.random.default_rng(3)
    events = [(int(rng.integers(0, 3)), int(i), int(rng.integers(0, 40_000))) for i in range(60)]
    queries = [(int(rng.integers(0, 4)), int(i), int(rng.integers(0, 40_000))) for i in range(200)]
    e, q = spark.createDataFrame(events, "k long, event_id long, at long"), spark.createDataFrame(queries, "k long, query_id long, at long")
    for forward in (True, False):
        got = {r.query_id: r.event_id for r in tt.as_of(q, e, "k", forward, slice_seconds=1000).collect()}
        for k, i, at in queries:
            fit = [(abs(t - at), n) for kk, n, t in events if kk == k and (t >= at if forward else t <= at)]
            assert got[i] == (min(fit)[1] if fit else None)


def test_cumulative_ranks(spark):
    rng = np.random.default_rng(4)
    values = [float(x) for x in rng.integers(0, 300, 2000)]
    got = {r.v: (r.c, r.before) for r in calibration.cumulative(spark.createDataFrame([(v,) for v in [*values, None]], "v double"), "v").collect()}
    assert got == {v: (values.count(v), sum(x < v for x in values)) for v in set(values)}


def test_pareto_of_two_costs(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 5)), int(rng.integers(0, 12)), int(rng.integers(0, 12))) for _ in range(300)]
    got = sorted(map(tuple, tt.pareto_front(spark.createDataFrame(rows, "k long, a long, b long"), "k", "a", "b").collect()))
    want = sorted(r for r in rows if not any(o[0] == r[0] and o[1] <= r[1] and o[2] <= r[2] and o[1:] != r[1:] for o in rows))
    assert got == want


def test_trips_ascend(spark):
    """Stop events of generated trips ascend by sequence, and by time."""
    events = spark.createDataFrame([(1, t, p, 10 + p, t * 600 + p * 100, t * 600 + p * 100 + 20) for t in range(5) for p in range(4)], "route long, trip long, pos long, stop long, arr long, dep long")
    for made, key in ((tt.thinned_trips(events, 2.0), "trip"), (tt.interpolated_trips(events, 0.5), "turn")):
        trips = {}
        for r in made.collect():
            trips.setdefault(r[key], []).append((r.pos, r.arr, r.dep))
        for own in trips.values():
            flat = [x for _, a, d in sorted(own) for x in (a, d)]
            assert [p for p, *_ in sorted(own)] == [0, 1, 2, 3] and flat == sorted(flat)
    assert len(trips) == 10


def test_samples_have_their_size(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(100)], "id long, h long")
    assert sampling.topped_up_sample(df, F.col("h"), "id", 40).count() == 40
    assert sampling.topped_up_sample(df, F.col("h"), "id", 3).count() == 3
    assert sampling.topped_up_sample(df, F.col("h"), "id", 400).count() == 100


@pytest.mark.parametrize("digits", [0, 1, 4])
def test_quotas_are_exact_whatever_the_strata(spark, digits):
    """A stratum of a third of the rows, one with a single key, a null one, an empty quota; each by the hash of its key."""
    rows = [(i, "large") for i in range(3000)] + [(7, "same")] * 500 + [(i, None) for i in range(60)] + [(None, "odd"), (1, "odd"), (2, "none")]
    df = spark.createDataFrame(rows, "id long, s string").repartition(6)
    quotas = {"large": 1001, "same": 123, "odd": 9, "none": 0}
    quota = lambda n, s: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), s), F.lit(20))
    got = sampling.with_taken(df, F.col("s"), quota, "id", digits=digits).collect()
    assert len(got) == len(rows)
    key = lambda i: (hashlib.md5(str(i).encode()).hexdigest() if i is not None else "", i or -1)
    for stratum in {s for _, s in rows}:
        own = sorted((i for i, s in rows if s == stratum), key=key)
        n = quotas.get(stratum, 20)
        assert sorted((r.id for r in got if r.s == stratum and r._taken), key=key) == own[:n]


def test_no_stratum_is_lost(spark):
    df = spark.createDataFrame([(i, i % 2 or None, i % 3) for i in range(20)], "id long, s long, taken long")
    assert sampling.topped_up_sample(df, F.col("s"), "id", 20).count() == 20
    assert sampling.topped_up_sample(df.drop("taken"), F.col("s"), "id", 10).where("s is null").count() == 5
    assert sampling.proportional_groups(df, "s", ["id"], 0.5).where("s is null").count() == 5
    split = sampling.stratified_split(df.select("id", "s"), "s", "id", 0.5)
    assert sorted(map(tuple, split.groupBy("s", "part").count().collect()), key=str) == sorted([(1, "train", 5), (1, "test", 5), (None, "train", 5), (None, "test", 5)], key=str)


def test_short_strata_are_filled_up_with_weights(spark):
    assert sampling.filled_quotas({"a": 5, "b": 100}, {"a": 0.5, "b": 0.2, "c": 0.3}, 40) == {"a": 5, "b": 35, "c": 0}
    assert sampling.filled_quotas({"a": 5, "b": 9}, {"a": 0.5, "b": 0.5}, 40) == {"a": 5, "b": 9}
    df = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(105)] + [(200, "z"), (201, None)], "id long, s string")
    got = sampling.filled_sample(df, F.col("s"), "id", {"a": 0.5, "b": 0.5}, 40)
    assert {(r.s, r["count"], round(r.weight, 9)) for r in got.groupBy("s", "weight").count().collect()} == {("a", 5, round(5 / 105 / (5 / 40), 9)), ("b", 35, round(100 / 105 / (35 / 40), 9))}
    assert sampling.filled_sample(df.limit(0), F.col("s"), "id", {"a": 1.0}, 3).count() == 0


def test_stops_of_other_modes_stay(spark):
    stops = spark.createDataFrame([(1, "BUS", 37.5, 127.0), (2, "OTHER", 37.5, 127.0), (3, None, 37.5, 127.0), (4, "SUBWAY", 10.0, 10.0)], "id long, mode string, lat double, lon double")
    known = spark.createDataFrame([(9, 37.5, 127.0)], "id long, lat double, lon double")
    assert sorted((r.id, r.mode, r.other) for r in cleaning.mapped_stops(stops, known).collect()) == [(1, "BUS", 9), (2, "OTHER", None), (3, None, None), (4, "SUBWAY", None)]


def test_empty_tables(spark):
    assert cleaning.unfinished(spark.createDataFrame([], "id long, chunk long"), spark.createDataFrame([(1,)], "chunk long")).count() == 0
    assert calibration.spearman(spark.createDataFrame([], "a double, b double"), "a", "b").first().n == 0


def test_common_subsequences_of_any_length(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    rng = np.random.default_rng(6)
    rows = [([int(x) for x in rng.integers(0, 6, n)], [int(x) for x in rng.integers(0, 6, m)]) for n, m in [(0, 0), (0, 4), (5, 0), (1, 1), (20, 61), (61, 20), (70, 62), (30, 90), *(map(int, x) for x in rng.integers(0, 75, (60, 2)))]]
    got = spark.createDataFrame(rows, "a array<int>, b array<int>").select("a", "b", arrays.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == lcs(r.a, r.b) for r in got) and len(got) == len(rows)
