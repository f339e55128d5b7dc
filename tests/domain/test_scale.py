"""What is asked of the operators where many rows are alike: work that doesn't grow with the pairs of them, and the same results."""

import time

import pytest
from pyspark.sql import functions as F

from farebox.operators import latent, spatial, timetable


def at_one_place(spark, n, lat=37.5):
    return spark.range(n).select("id", F.lit(lat).alias("lat"), F.lit(127.0).alias("lon"))


def test_nearest_of_many_at_one_place(spark):
    n, start = 40_000, time.monotonic()
    left = at_one_place(spark, n)
    found = spatial.nearest(left, left.union(at_one_place(spark, n, 37.501)), 500.0, 3)
    assert found.groupBy("rank", "other").count().orderBy("rank").collect() == [(k + 1, k, n) for k in range(3)]
    assert time.monotonic() - start < 40  # 3,200,000,000 pairs otherwise


def test_nearest_of_repeated_ids(spark):
    left = spark.createDataFrame([(1, 37.5, 127.0), (1, 37.501, 127.0), (2, 37.5, 127.0), (3, None, 127.0)], "id long, lat double, lon double")
    right = spark.createDataFrame([(7, 37.5, 127.0), (7, 37.5, 127.0), (6, 37.501, 127.0), (5, 37.6, 127.0)], "id long, lat double, lon double")
    got = spatial.nearest(left, right, 500.0, 4).orderBy("id", "rank").collect()
    assert [(r.id, r.rank, r.other, round(r.metres)) for r in got] == [(1, 1, 6, 0), (1, 2, 7, 0), (1, 3, 7, 0), (1, 4, 6, 111), (2, 1, 7, 0), (2, 2, 7, 0), (2, 3, 6, 111)]


def test_transfers_of_many_at_one_place(spark):
    stops = at_one_place(spark, 300).union(spark.createDataFrame([(900, 37.501, 127.0), (901, 38.5, 127.0)], "id long, lat double, lon double"))
    assert spatial.transfers(stops, 500.0).groupBy(F.col("metres") > 0).count().orderBy("count").collect() == [(True, 600), (False, 300 * 299)]
    plan = spatial.transfers(stops, 500.0, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("ATAN2")  # distances are of places, before stops meet


def test_interpolated_trips_are_made_last(spark):
    """Rows that explode makes are taken to be few: joined, they went to the driver as a broadcast."""
    events = spark.range(60_000).select((F.col("id") % 2).alias("route"), F.col("id").alias("trip"), F.lit(0).alias("pos"), F.lit(5).alias("stop"), (F.col("id") * 3).alias("arr"), (F.col("id") * 3 + 1).alias("dep"))
    made = timetable.interpolated_trips(events, 0.5)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")
    got = made.groupBy("route").agg(F.count("*").alias("n"), F.countDistinct("turn").alias("d"), F.min("turn").alias("a"), F.max("turn").alias("z"), F.min("dep").alias("first"), F.max("dep").alias("last")).orderBy("route").collect()
    step = (29_999 * 6) // 59_999
    assert [tuple(r) for r in got] == [(k, 60_000, 60_000, 0, 59_999, 3 * k + 1, 3 * k + 1 + 59_999 * step) for k in (0, 1)]


@pytest.mark.parametrize("n", [1, 2, 4097])
def test_interpolated_departures(spark, n):
    trips = spark.range(n).select(F.lit(1).alias("route"), (F.col("id") * 100).alias("dep"))
    got = sorted((r.turn, r.dep) for r in timetable.interpolated(trips, 0.4).collect())
    m = -(-n * 5 // 2) if n > 1 else 1
    assert got == [(i, i * (((n - 1) * 100) // max(m - 1, 1))) for i in range(m)]


def test_classes_that_differ_in_the_last_bits_tie(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 0.0), (2, 1, 0.5, 1.0)], "chain_id long, choice int, x double, z double")
    mixed = latent.with_mixture(df, ["x"], [[0.3], [0.1]], ["z"], [[-1e-13, -1e-6]])
    assert [r["class"] for r in latent.posteriors(mixed, 2).orderBy("chain_id").collect()] == [0, 1]
