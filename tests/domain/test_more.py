"""Readers, searches and the mixed logit."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from farebox.functions import text
from farebox.operators import mixed
from farebox.sources import timetable as files


def test_headers_and_manifest(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("﻿stop_id,stop_name,stop_lat,stop_lon\ns1,A,37.1,127.1\n")
    files.check_columns(spark, str(tmp_path / "stops.txt"), "stops")
    with pytest.raises(ValueError, match="route_type"):
        files.check_columns(spark, str(tmp_path / "stops.txt"), "routes")
    (tmp_path / "m.txt").write_text("# c\n\na.json, out/a\nnone\nb.json,x,y\n")
    assert sorted(map(tuple, files.read_manifest(spark, str(tmp_path / "m.txt")).collect())) == [("a.json", "out/a"), ("b.json", "x,y")]


def test_routes_files_and_lines(spark, tmp_path):
    (tmp_path / "routes.txt").write_text("route_id,agency_id,route_short_name,route_long_name,route_type\nr2,a,2,Two,1\nr1,a,2,Two,1\nr3,a,3,Three,3\nr4,a,4,Four,x\n")
    routes = files.read_table(spark, str(tmp_path / "routes.txt"), "routes")
    assert {r.route_id for r in routes.collect()} == {"r1", "r2", "r3"}
    (tmp_path / "trips.txt").write_text("route_id,service_id,trip_id\nr1,s,t1\nr9,s,t2\n")
    trips = files.read_table(spark, str(tmp_path / "trips.txt"), "trips")
    (tmp_path / "lines.json").write_text(json.dumps({"K2": {"gtfs_name": "2"}, "K3": {"gtfs_name": "3"}}))
    assert [tuple(r) for r in files.read_line_mapping(spark, str(tmp_path / "lines.json"), routes).collect()] == [("K2", "r1")]
    times = spark.createDataFrame([("t1", "s1", 1), ("t2", "s1", 1), ("t3", "s1", 1)], "trip_id string, stop_id string, stop_sequence int")
    assert [(r.trip_id, r.route_short_name) for r in files.trips_with_routes(times, trips, routes).collect()] == [("t1", "2")]


def test_results_are_resumed(spark, tmp_path):
    path = str(tmp_path / "out")
    assert files.finished_chunks(spark, path).count() == 0
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, chunk long")
    files.write_results(df, path)
    files.write_results(df.where("chunk = 1"), path)
    assert sorted(r.chunk for r in files.finished_chunks(spark, path).collect()) == [0, 1] and spark.read.json(path).count() == 3


def test_names_and_escapes(spark):
    df = files.resolved(spark.createDataFrame([(1, 2)], "DEP long, x long"), {"departure": ["dep", "DEP"]})
    assert df.columns == ["departure", "x"]
    with pytest.raises(ValueError, match="no column"):
        files.resolved(df, {"arrival": ["arr"]})
    fixed = spark.createDataFrame([('{"a":"x\\"}',)], "v string").select(files.closed_strings(F.col("v")).alias("v")).first().v
    assert json.loads(fixed) == {"a": "x\\"}


def test_route_search(spark):
    routes = spark.createDataFrame([("1", "Line 2", 1), ("2", "N2", 3), ("3", None, 3), ("4", "line 22", 401)], "id string, name string, type int")
    hits = lambda p: sorted(r.id for r in routes.where(text.search_hit(F.col("id"), F.col("name"), F.col("type"), p)).collect())
    assert hits("2") == ["1", "2", "4"] and hits("ROUTE:2") == ["2"] and hits("버스_n") == ["2"] and hits("지하철_LINE") == ["1", "4"] and hits(" ") == []


def test_mixed_logit(spark):
    assert mixed.halton(4, 2).tolist() == [0.5, 0.25, 0.75, 0.125]
    draws = mixed.normal_draws(200, 1)
    assert abs(draws.mean()) < 0.05 and abs(draws.std() - 1) < 0.1
    rng, rows = np.random.default_rng(7), []
    for c in range(900):
        x = rng.normal(size=(3, 2))
        v = x[:, 0] * -1.0 + x[:, 1] * rng.normal(1.0, 1.5)
        p = np.exp(v - v.max())
        pick = rng.choice(3, p=p / p.sum())
        rows += [(c, int(a == pick), float(x[a, 0]), float(x[a, 1])) for a in range(3)]
    df = spark.createDataFrame(rows, "chain_id long, choice int, x double, y double")
    grouped = mixed.grouped(df, "x", "y").cache()
    at, z = np.array([-0.5, 0.4, -0.2]), mixed.normal_draws(20, 1)
    ll, g = mixed.likelihood(grouped, ["x"], ["y"], at, z)
    want = 0.0
    for c in range(900):
        own = rows[3 * c : 3 * c + 3]
        ps = []
        for d in z[:, 0]:
            e = [np.exp(at[0] * r[2] + (at[1] + np.exp(at[2]) * d) * r[3]) for r in own]
            ps.append(e[[r[1] for r in own].index(1)] / sum(e))
        want += np.log(np.mean(ps) + 1e-10)
    assert ll == pytest.approx(want, abs=1e-6)
    for i in range(3):
        e = 1e-5 * np.eye(3)[i]
        assert (mixed.likelihood(grouped, ["x"], ["y"], at + e, z)[0] - mixed.likelihood(grouped, ["x"], ["y"], at - e, z)[0]) / 2e-5 == pytest.approx(g[i], abs=1e-3)
    got = mixed.fit(df, ["x"], ["y"], n_draws=60, rounds=30)
    p = {k: v["value"] for k, v in got["parameters"].items()}
    assert got["converged"] and abs(p["x"] + 1) < 0.3 and abs(p["mean_y"] - 1) < 0.4 and abs(p["spread_y"] - 1.5) < 0.6
    assert mixed.weight_interval(-2.0, 0.5, -0.5) == pytest.approx((2.04, 5.96))
