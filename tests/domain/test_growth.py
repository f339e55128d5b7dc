"""What is shuffled, and what a task holds, on tables that grow."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from farebox.functions import tolerant
from farebox.operators import latent, matching, mixed
from farebox.plans import derive as d
from farebox.plans import matching as plans
from farebox.plans import sequences

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_grow_with_the_table(spark, monkeypatch):
    least = spark.sparkContext.defaultParallelism
    assert d.dealt(spark.range(1000), "id", 10).rdd.getNumPartitions() == 100
    assert d.dealt(spark.range(1000), "id").rdd.getNumPartitions() == least


def test_choice_sets_are_shuffled_once(spark):
    rows = d.alternatives(spark, SF)
    assert plan(rows).count("Exchange") == 1
    assert plan(latent.packed(rows, list(d.POOLED), [])).count("Exchange") == 1
    assert plan(mixed.grouped(rows, *d.POOLED)).count("Exchange") == 1


def test_mixed_likelihood_takes_one_choice(spark):
    rows = [(1, 1, 0.5, 1.0), (1, 0, 2.0, 0.0), (2, 0, 1.0, 1.0), (3, 1, 1.0, 1.0), (3, 1, 0.0, 1.0), (4, 0, 1.0, 3.0), (4, 1, 0.0, 2.0), (4, 0, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "chain_id long, choice int, x double, y double").repartition(3)
    at, z = [-0.5, 0.4, -0.2], mixed.normal_draws(8, 1)
    chains, ll, g = mixed.totals(mixed.grouped(df, "x", "y"), ["x"], ["y"], at, z)
    want = 0.0
    for c in (1, 4):
        own = [r for r in rows if r[0] == c]
        e = np.array([[np.exp(at[0] * r[2] + (at[1] + np.exp(at[2]) * d) * r[3]) for r in own] for d in z[:, 0]])
        want += np.log((e / e.sum(axis=1, keepdims=True))[:, [r[1] for r in own].index(1)].mean() + 1e-10)
    assert chains == 2 and ll == pytest.approx(want) and g.shape == (3,)
    assert mixed.totals(mixed.grouped(df.where(F.lit(False)), "x", "y"), ["x"], ["y"], at, z)[:2] == (0, 0.0)


def test_plain_identifiers_translate_where_they_are(spark):
    pairs = spark.createDataFrame([(1, 10, 1), (2, 20, 3), (2, 19, 2), (None, 5, 4), (3, None, 5)], "a long, b long, place int")
    df = spark.createDataFrame([(1, 1, 2), (2, None, 9), (2, 3, 1), (2, 3, 1)], "e long, a long, value long")
    got = matching.with_translated_values(df, pairs, "a", "b", "a", "value", order="place")
    assert got.columns == df.columns and sorted(got.collect(), key=str) == sorted([(1, 10, 20), (2, None, None), (2, None, 10), (2, None, 10)], key=str)
    few = spark.range(5).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    made = matching.with_translated_values(d.dealt(df, "e"), few, "a", "b", "a", "value").groupBy("e").agg(F.collect_list("a"))
    assert plan(made).count("hashpartitioning(e") == 1


def test_journeys_are_shuffled_once_by_chain(spark):
    wanted = spark.range(50).select(F.col("id").alias("chain_id"))
    assert plan(plans._journeys(spark, SF, wanted)).count("hashpartitioning(chain_id") == 1


def test_legs_are_made_of_one_shuffle_of_lines(spark):
    made = plan(sequences.assembled_legs(spark, SF))
    assert made.count("lineitem.parquet") == 1 and made.count("hashpartitioning(request") + made.count("hashpartitioning(o_orderkey") <= 2


def test_tolerant_measures_of_many_pairs(spark):
    """The cells of tables are computed for many pairs at once."""
    stop = lambda k, i: F.struct(((k + i) % 50).alias("id"), (37.5 + (k + i) % 50 * 0.001).alias("lat"), F.lit(127.0).alias("lon"))
    some = lambda k: F.array(*(stop(k, i) for i in range(7)))
    df = spark.range(200_000).select(some(F.col("id")).alias("a"), some(F.col("id") + 1).alias("b"), F.array(*map(F.lit, ["BUS", None, "RAIL"])).alias("m"), F.array(*map(F.lit, ["BUS", None, "SUBWAY", "x"])).alias("n"))
    start = time.monotonic()
    got = df.select(F.round(tolerant.tolerant_similarity("a", "b"), 6).alias("s"), F.round(tolerant.mode_similarity("m", "n"), 6).alias("t")).groupBy("s", "t").count().collect()
    assert time.monotonic() - start < 15
    near = 1 - 6_371_000.0 * np.radians(0.001) / 300
    wrapped = sum(r["count"] for r in got if abs(r.s - 6 / 7) > 1e-6)
    assert near > 0 and {r.t for r in got} == {round(1 - 1.3 / 4, 6)} and wrapped <= 7 * 200_000 / 50 and sum(r["count"] for r in got) == 200_000
