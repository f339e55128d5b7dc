"""Numbers in a total order over many ranges."""

from pyspark.sql import functions as F

from farebox.operators.ordinals import numbered


def test_consecutive_in_order_over_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 1009).alias("x"), F.col("id").alias("y")).repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = numbered(rows, F.desc("x"), "y", name="n", first=1).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [(r.x, r.y) for r in sorted(got, key=lambda r: r.n)] == sorted(((r.x, r.y) for r in got), key=lambda p: (-p[0], p[1]))
    assert sorted(r.n for r in got) == list(range(1, 5001))


def test_equal_rows_are_spread_and_nulls_have_a_place(spark):
    rows = spark.createDataFrame([(1, "a")] * 300 + [(None, "b")] * 3, "x int, ordinal_of string").repartition(5)
    got = numbered(rows, "x").collect()
    assert sorted(r.ordinal for r in got) == list(range(303)) and {r.ordinal for r in got if r.x is None} == {0, 1, 2}


def test_empty(spark):
    assert numbered(spark.createDataFrame([], "x int"), "x").collect() == []
