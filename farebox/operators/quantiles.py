"""Values at exact places of the sorted rows of groups, without a state that holds a group's values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farebox.sources.shared import written

#: Parts into which a group's distinct values are dealt.
PARTS = 64
#: Groups whose bounds go to every task; those of more are joined.
MANY = 10_000


def values_at(df: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each group of by (none: one row) n, its rows with a value, and for each name the value at place places[name](n), from 0, of the sorted values.

    Distinct values with their counts are written once. Approximate quantiles deal a group's values into parts; sums of the parts tell which part holds
    a place, and only those parts are put in order, each by itself. A place outside of 0 to n - 1 gives null; nulls don't count, and groups of nulls alone
    have no row; null is a group like any other.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.struct(F.lit(0).alias("_"), *by).alias("g"), F.col(value).alias("v"))
    counts = written(rows.groupBy("g", "v").agg(F.count("*").alias("c")), "counts")
    shares = [i / PARTS for i in range(1, PARTS)]
    groups = written(counts.groupBy("g").agg(F.sum("c").alias("n"), F.percentile_approx("v", shares, 10_000).alias("b")), "groups")
    small = F.broadcast if groups.count() <= MANY else lambda x: x
    dealt = counts.join(small(groups.select("g", "b")), "g").select("g", "v", "c", F.size(F.filter("b", lambda b: b < F.col("v"))).alias("part"))
    sums = dealt.groupBy("g", "part").agg(F.sum("c").alias("s"))
    sums = sums.withColumn("before", F.sum("s").over(Window.partitionBy("g").orderBy("part")) - F.col("s"))  # PARTS rows a group
    asked = groups.select("g", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), f(F.col("n")).cast("long").alias("at")) for i, f in enumerate(places.values())))).alias("a")).select("g", "a.*")
    wanted = written(sums.join(asked, "g").where("before <= at and at < before + s").select("g", "part", "i", (F.col("at") - F.col("before")).alias("at")), "wanted")
    within = dealt.join(small(wanted.select("g", "part").distinct()), ["g", "part"], "left_semi")
    within = within.withColumn("w", F.sum("c").over(Window.partitionBy("g", "part").orderBy("v")) - F.col("c"))
    found = within.join(small(wanted), ["g", "part"]).where("w <= at and at < w + c").select("g", "i", "v")
    told = found.groupBy("g").agg(*(F.max(F.when(F.col("i") == i, F.col("v"))).alias(name) for i, name in enumerate(places)))
    return groups.select("g", "n").join(told, "g", "left").select(*(F.col("g")[c].alias(c) for c in by), "n", *places)


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each group n and exact quantiles, linear between the two nearest values."""
    places = {}
    for name, share in shares.items():
        places[f"_{name}0"] = lambda n, q=share: F.floor((n - 1) * F.lit(q))
        places[f"_{name}1"] = lambda n, q=share: F.ceil((n - 1) * F.lit(q))
    found = values_at(df, by, value, places)
    at = lambda q: (F.col("n") - 1) * F.lit(q)
    return found.select(*by, "n", *((F.col(f"_{name}0") + (F.col(f"_{name}1") - F.col(f"_{name}0")) * (at(q) - F.floor(at(q)))).alias(name) for name, q in shares.items()))
