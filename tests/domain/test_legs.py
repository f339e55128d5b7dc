"""Legs, rides on loops, notations, requests, chunks and journeys of a stream against plain computations."""

import ast
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from farebox.functions import notation
from farebox.operators import journeys, legs
from farebox.sources import timetable as files
from farebox.streaming.demand import journey_states


def test_legs_of_different_shapes_become_one_journey(spark):
    access = spark.createDataFrame([(1, 100, 60, "a", 37.0, 127.0)], "request long, start long, seconds long, stop string, lat double, lon double")
    transit = spark.createDataFrame([(1, 160, 600, "a", "b", "BUS", "r1"), (1, 850, 60, "c", "x", "SUBWAY", "r2"), (2, 5, 6, "a", "a", "RAIL", None)], "request long, start long, seconds long, src string, dst string, mode string, route string")
    transfers = spark.createDataFrame([(1, 760, 90, "b", "c")], "request long, start long, seconds long, src string, dst string")
    egress = spark.createDataFrame([(1, 910, 30, "x", 37.5, 127.5)], access.schema)
    stops = spark.createDataFrame([("a", "A", 37.1, 127.1), ("b", 'B "q"', 37.2, 127.2), ("c", "C", 37.3, 127.3)], "stop string, name string, lat double, lon double")
    got = {r.request: r for r in legs.assembled(access, transit, transfers, egress, stops).collect()}
    one = json.loads(got[1].json)
    assert [(x["mode"], x["start"], x["end"], x["from"]["name"], x["to"]["name"]) for x in one["legs"]] == [("WALK", 100, 160, "Origin", "A"), ("BUS", 160, 760, "A", 'B "q"'), ("WALK", 760, 850, 'B "q"', "C"), ("SUBWAY", 850, 910, "C", None), ("WALK", 910, 940, None, "Destination")]
    assert one["legs"][0]["distance"] == 72.0 and one["legs"][0]["cost"] == 120 and one["legs"][3]["to"] == {"name": None, "lat": None, "lon": None, "stop": "x"}
    assert (got[1].walk_seconds, got[1].ride_seconds, got[1].transfers, got[1].modes, got[1].start, got[1].end) == (180, 660, 1, ["BUS", "SUBWAY"], 100, 940)
    assert got[2].transfers == 0 and json.loads(got[2].json)["legs"][0]["route"] is None
    empty = legs.assembled(*(t.limit(0) for t in (access, transit, transfers, egress)), stops)
    assert empty.collect() == []


def test_rides_on_loops(spark):
    route = {"loop": "abcdab", "line": "xyz"}
    stops = spark.createDataFrame([(r, i, s) for r, own in route.items() for i, s in enumerate(own)], "route string, pos long, stop string").repartition(3)
    asked = [("loop", "a", "b"), ("loop", "d", "b"), ("loop", "b", "a"), ("loop", "c", "c"), ("line", "z", "x"), ("line", "q", "x"), ("line", "x", "q"), ("no", "x", "y"), (None, "x", "y"), ("line", None, "y")]
    rides = spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "leg int, route string, board string, alight string")
    got = {r.leg: (r.status, r.at, r.to, "".join(r.stops)) for r in legs.traversed_stops(legs.leg_positions(rides, stops), stops).collect()}
    assert got == {
        0: ("ok", 0, 1, "ab"), 1: ("ok", 3, 5, "dab"), 2: ("ok", 1, 4, "bcda"), 3: ("ok", 2, 2, "c"), 4: ("ok", 2, 0, "zx"), 5: ("board_not_found", None, None, ""),
        6: ("alight_not_found", None, None, ""), 7: ("no_route", None, None, ""), 8: ("no_route", None, None, ""), 9: ("board_not_found", None, None, ""),
    }
    visits = {r.stop: [tuple(v) for v in r.visits] for r in legs.visits_by_stop(stops).collect()}
    assert visits["a"] == [("loop", 0), ("loop", 4)] and visits["z"] == [("line", 2)]


def test_two_notations_and_back(spark):
    texts = ['["a", 1, null]', "['a', 'b']", "[1, 2.5, None, True]", "('x', \"it's\",)", "['it\\'s', 'a\\\\b']", "[]", "[ ]", '["a"', "['a' 'b']", "['a', b]", "", None, "x", '{"a": 1}', "['" + "y" * 50_000 + "']", "['ä, ]', '[']"]
    got = [r.r for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(notation.read_list(F.col("t")).alias("r")).collect()]
    assert [r.notation for r in got] == ["json", *["literal"] * 4, "json", "json", *[None] * 7, "literal", "literal"]
    assert got[0]["values"] == ["a", "1", None] and got[4]["values"] == ["it's", "a\\b"] and got[3]["values"] == ["x", "it's"] and got[15]["values"] == ["ä, ]", "["]
    for t, r in zip(texts, got, strict=True):
        if r.notation is None:
            assert r.damaged == t and r["values"] is None
        elif r.notation == "literal":
            assert r["values"] == [None if x is None else str(x) for x in ast.literal_eval(t)] and r.damaged is None
    values = [["a", None, "it's \\ \n\t\"q\""], [], ["1"]]
    back = spark.createDataFrame([(v,) for v in values], "v array<string>").select("v", notation.read_list(notation.as_literal(F.col("v"))).alias("l"), notation.read_list(notation.as_json(F.col("v"))).alias("j")).collect()
    assert all(r.l["values"] == r.v == r.j["values"] for r in back)


def test_requests_are_numbered_over_many_parts(spark, tmp_path):
    lines = ["from_lat,from_lon,to_lat,to_lon,t", *(f"{i},2,3,4,08:{i % 60:02d}" if i % 10 else "short,1" for i in range(4000))]
    (tmp_path / "od.csv").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = files.read_requests(spark, str(tmp_path / "od.csv")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [i for i in range(4000) if i % 10]
    assert sorted((r.id, r.from_lat, r.at) for r in got) == [(k, float(i), 8 * 3600 + 60 * (i % 60)) for k, i in enumerate(want)]
    (tmp_path / "bad.csv").write_text("1,2,3,4,08:00\n1,2,3,4,08:00\n1,2,x3,4,08:30\n")
    with pytest.raises(Exception, match="not a number: x3"):
        files.read_requests(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "none.csv").write_text("")
    assert files.read_requests(spark, str(tmp_path / "none.csv")).collect() == []


def test_a_run_that_ended_before_its_commit_is_done_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, chunk long")
    chunks = spark.createDataFrame([(0,), (1,), (2,)], "chunk long")
    with monkeypatch.context() as m:
        m.setattr(files, "_manifest", lambda _: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            files.write_results(df, path, chunks=chunks)
    assert spark.read.json(path).count() == 3 and files.finished_chunks(spark, path).count() == 0
    files.write_results(df, path, chunks=chunks)
    assert sorted(r.chunk for r in files.finished_chunks(spark, path).collect()) == [0, 1, 2] and spark.read.json(path).count() == 3
    (tmp_path / "out" / "chunk=0" / "broken.json").write_text("{")
    assert all("/out.chunks/" in f for f in files.finished_chunks(spark, path).inputFiles())


def test_first_line_of_a_name_in_the_order_of_the_file(spark, tmp_path):
    (tmp_path / "lines.json").write_text(json.dumps({"K2": {"gtfs_name": "2"}}))
    routes = spark.createDataFrame([("r9", "2", 1, 0), ("r1", "2", 1, 1), ("r0", "2", 3, 2)], "route_id string, route_short_name string, route_type int, place int")
    assert files.read_line_mapping(spark, str(tmp_path / "lines.json"), routes).first().route == "r9"


def test_journeys_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    rng, base, rows = random.Random(5), pd.Timestamp("2024-05-01T05:00:00Z"), []
    for i in range(600):
        rows.append((i, f"c{rng.randrange(12)}", base + pd.Timedelta(seconds=60 * i + rng.randrange(3600)), rng.random() < 0.2))
    files_ = [rows[k : k + 100] for k in range(0, 600, 100)]  # within a file in any order, between files up to an hour late
    folder, schema = tmp_path / "taps", "tap_id long, card string, ts timestamp, starts boolean"
    end = (10_000, "clock", base + pd.Timedelta(days=2), False)
    folder.mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for own in [*files_, [end], [(10_001, "clock", base + pd.Timedelta(days=3), True)]]:
        rng.shuffle(own)
        spark.createDataFrame([(i, c, t.to_pydatetime(), s) for i, c, t, s in own], schema).coalesce(1).write.mode("append").parquet(str(folder))
    query = journey_states(source, "card", late="2 hours").writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.card, int(r.start.timestamp()), int(r.last.timestamp()), r.legs) for r in spark.table("told").where("card <> 'clock'").collect())
    taps = spark.createDataFrame([(i, c, int(t.timestamp()), s) for i, c, t, s in rows], "tap_id long, card string, at long, first boolean")
    batch = journeys.sessions(taps, start=F.col("first")).groupBy("card", "journey").agg(F.min("at"), F.max("at"), F.count("*")).collect()
    assert got == sorted((r[0], r[2], r[3], r[4]) for r in batch) and any(r[4] > 2 for r in batch)
