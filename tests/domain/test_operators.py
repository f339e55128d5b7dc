import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from farebox.functions import arrays, geo, text, times
from farebox.operators import choice, timetable
from farebox.sources import timetable as files
from farebox.streaming import demand


def values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_times(spark):
    cases = ["25:30:00", "07:05", "", None, "x:1:2", " 8:00:01 ", "1:2:3:4"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select(times.parse_time(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == [91_800, 25_500, -1, -1, None, 28_801, None]
    lit = F.lit
    assert values(spark, times.hhmm(lit(91_800)), times.hhmmss(lit(-1)), times.duration_text(lit(41)), times.duration_text(lit(11_100)), times.to_minutes(lit(90)), times.epoch_millis(lit(1)), times.is_peak(lit(7 * 3600)), times.is_peak(lit(9 * 3600)), times.compact_to_seconds(lit(20240103070510))) == ["25:30", "--:--:--", "41s", "3h 5m", 2, 1_768_860_001_000, True, False, 25_510]


def test_text_and_geo(spark):
    lit = F.lit
    assert values(spark, text.code(lit("1:BS_3100_116000008")), text.code(lit("1:abc")), text.code(lit("")), text.display_name(lit("-"), lit(" L "), lit("i")), text.display_name(lit(""), lit(None).cast("string"), lit("i")), text.mode(lit(101)), text.mode(lit(-1)), text.standard_route_type(lit(9)), text.is_kind(lit(450), "subway"), text.feed_id(lit(None).cast("string"))) == ["116000008", "abc", None, "L", "i", "RAIL", "BUS", None, True, "1:unknown"]
    assert values(spark, F.round(geo.haversine(lit(37.5), lit(127.0), lit(37.5), lit(127.01)), 0), geo.walk_seconds(lit(120.5)), geo.distance_text(lit(1250.0)), geo.distance_text(lit(80.4))) == [882.0, 101, "1.3km", "80m"]


def lcs(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return int(table[-1, -1])


def test_sequences_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [([rng.randrange(5) for _ in range(rng.randrange(9))], [rng.randrange(5) for _ in range(rng.randrange(9))]) for _ in range(60)]
    pairs += [([], []), ([1], []), ([1, 2, 3], [3, 2, 1])]
    a, b = F.col("a"), F.col("b")
    for r in spark.createDataFrame(pairs, "a array<int>, b array<int>").select("a", "b", arrays.lcs_length(a, b).alias("n"), arrays.lcs_similarity(a, b).alias("s"), arrays.jaccard(a, b).alias("j")).collect():
        n, empty = lcs(r.a, r.b), (not r.a) + (not r.b)
        assert r.n == n
        assert abs(r.s - (2 * n / (len(r.a) + len(r.b)) if not empty else empty - 1)) < 1e-12
        assert abs(r.j - (len({*r.a} & {*r.b}) / len({*r.a} | {*r.b}) if not empty else empty - 1)) < 1e-12


def test_traversed(spark):
    cases = [([1, 2, 3, 4], 2, 4, "ok", [2, 3, 4]), ([1, 2, 3, 4], 4, 2, "ok", [4, 1, 2]), ([1, 2], 9, 1, "board_not_found", []), ([1, 2], 1, 9, "alight_not_found", []), (None, 1, 2, "no_route", None)]
    df = spark.createDataFrame([c[:3] for c in cases], "r array<int>, a int, b int").select(arrays.traversed(F.col("r"), F.col("a"), F.col("b")).alias("t"))
    assert [(r.t.status, r.t.stops) for r in df.collect()] == [c[3:] for c in cases]


def test_logit_fit_finds_the_coefficients(spark):
    rng, rows = np.random.default_rng(1), []
    for c in range(3000):
        x = rng.normal(size=(4, 2))
        u = x @ np.array([-1.0, 0.5]) + rng.gumbel(size=4)
        rows += [(c, k, *map(float, x[k]), int(k == u.argmax())) for k in range(4)]
    df = spark.createDataFrame(rows, "chain_id long, alt_id long, a double, b double, choice int").cache()
    fit = choice.fit_logit(df, ["a", "b"])
    assert abs(fit["a"]["beta"] + 1) < 4 * fit["a"]["se"] and abs(fit["b"]["beta"] - 0.5) < 4 * fit["b"]["se"] < 0.2


def test_readers(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("﻿stop_id,stop_name,stop_lat,stop_lon,zone\na, One ,37.5,127.0,x\n\nb,Two,bad,127\na,Again,37.6,127.1\nshort,1\n")
    assert sorted(map(tuple, files.read_table(spark, str(tmp_path / "stops.txt"), "stops").collect())) == [("a", "Again", 37.6, 127.1)]
    (tmp_path / "st.txt").write_text("trip_id,arrival_time,departure_time,stop_id,stop_sequence,p,d\nt,25:30:00,,s,1.000000000,0,0\nt,1,2,s,2,0,0\n")
    assert [(r.arr, r.dep, r.stop_sequence) for r in files.read_table(spark, str(tmp_path / "st.txt"), "stop_times").collect()] == [(91_800, -1, 1)]
    (tmp_path / "od.csv").write_text("from_lat,from_lon,to_lat,to_lon,t\n1,2,3,4,08:30\n5,6,7\n5,6,7,8,09:00\n")
    assert [(r.id, r.at) for r in files.read_requests(spark, str(tmp_path / "od.csv")).orderBy("id").collect()] == [(0, 30_600), (1, 32_400)]
    leg = '{"mode":"%s","duration":%d,"route":"r","legGeometry":{"points":"a\\\\\\"b\\\\"}}'
    one = '{"id":1,"data":{"plan":{"itineraries":[{"duration":900,"legs":[' + ",".join([leg % ("WALK", 60), leg % ("BUS", 300), leg % ("SUBWAY", 400)]) + "]}]}}}"
    (tmp_path / "r.json").write_text(one + '\nnot json\n{"id":2,"data":{"plan":{"itineraries":[]}}}\n')
    got = {r.od_id: r for r in files.read_results(spark, str(tmp_path / "r.json")).collect()}
    assert got.keys() == {1, 2} and got[2].alt_id is None
    assert (got[1].ride_time_sec, got[1].walk_time_sec, got[1].wait_time_sec, got[1].n_transfers, got[1].modes) == (700, 60, 140, 1, ["BUS", "SUBWAY"])


def test_thinning_keeps_the_rounded_places(spark):
    for n, f in ((1, 2.0), (7, 1.0), (10, 2.5), (9, 3.7), (4, 100.0)):
        df = spark.range(n).selectExpr("1 as route", "cast(id as int) as turn", "id as dep")
        want = {min(int(i * f + 0.5), n - 1) for i in range(max(1, int(np.ceil(n / f))))}
        assert {r.turn for r in timetable.thinned(df, f).collect()} == want


def test_streams(spark, tmp_path):
    taps = spark.sql("select timestamp'2024-01-01 08:00:00' + make_interval(0,0,0,0,0,id * 20,0) as ts, id % 2 as card from range(12)")
    taps.write.parquet(str(tmp_path / "taps"))
    stream = spark.readStream.schema(taps.schema).parquet(str(tmp_path / "taps"))
    for name, df in (("quarters", demand.demand_windows(stream, "card")), ("journeys", demand.journey_windows(stream, "card"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("quarters").count() == 12
    assert sorted(r.legs for r in spark.table("journeys").collect()) == [6, 6]


def test_shortest_paths_go_beyond_64_hops(spark):
    from farebox.operators.spatial import shortest_paths

    edges = spark.createDataFrame([(i, i + 1, 0.0 if i % 2 else 1.0) for i in range(70)], "src long, dst long, cost double")
    sources = spark.createDataFrame([(0,)], "source long")
    got = {r.node: r.cost for r in shortest_paths(edges, sources, 100.0).collect()}
    assert got == {i: float((i + 1) // 2) for i in range(71)}
    with pytest.raises(RuntimeError):
        shortest_paths(edges, sources, 100.0, rounds=3)
