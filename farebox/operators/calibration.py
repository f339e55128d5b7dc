"""Objectives of a calibration: expected and picked similarity with weights, rank correlation, cost parameters from coefficients, costs of legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The largest walking reluctance and transfer cost in seconds that coefficients may give.
WALK_CAP, TRANSFER_CAP = 6.0, 300.0
#: Seconds of a first boarding, and the route types that are subways in the costs.
FIRST_BOARD, SUBWAYS = 60, (1, 12)


def objectives(scored: DataFrame, weights: DataFrame, *by: str) -> DataFrame:
    """For each group: f1 and f2, the similarity and exact match that the probabilities let expect; those of the cheapest and of the most useful
    alternative; all weighted by the inverse sampling probability of the chain (weights: chain_id, weight; 1 without one).

    scored: chain_id, alt_id, p, v, sim, exact, cost and the columns of by. Chains are aggregated once, then joined to their weights.
    """
    pick = F.struct("sim", "exact")
    chains = scored.groupBy("chain_id", *by).agg(
        F.sum(F.col("p") * F.col("sim")).alias("f1"), F.sum(F.col("p") * F.col("exact")).alias("f2"),
        F.min_by(pick, F.struct("cost", "alt_id")).alias("det"), F.max_by(pick, F.struct("v", -F.col("alt_id"))).alias("mnl"),
    )
    rows = chains.join(weights, "chain_id", "left").withColumn("w", F.coalesce("weight", F.lit(1.0)))
    mean = lambda c, name: (F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(name)
    return rows.groupBy(*by).agg(F.count("*").alias("chains"), mean("f1", "f1"), mean("f2", "f2"), mean("det.sim", "det_sim"), mean("det.exact", "det_exact"), mean("mnl.sim", "mnl_sim"), mean("mnl.exact", "mnl_exact"))


def combined(results: DataFrame, population: DataFrame, kind: str, *measures: str) -> DataFrame:
    """One row: measures of each kind, weighted by its share of the population (kind, n); kinds without a result don't count."""
    rows = results.join(population.select(kind, F.col("n").alias("_n")), kind)
    return rows.agg(*((F.sum(F.col(m) * F.col("_n")) / F.sum("_n")).alias(m) for m in measures))


def theta(walk: Column, ride: Column, transfer: Column) -> Column:
    """(walk_reluctance, transfer_seconds) from coefficients, capped; null if the ride's is zero."""
    reluctance = F.round(F.least(F.abs(walk / ride), F.lit(WALK_CAP)), 2)
    seconds = F.bround(F.least(F.abs(transfer / ride) * 60, F.lit(TRANSFER_CAP)), 0)
    return F.when(ride != 0, F.struct(reluctance.alias("walk_reluctance"), seconds.alias("transfer_seconds")))


def scaled_theta(pooled: Column, weight: Column, pooled_weight: Column) -> Column:
    """A type's parameter: the pooled one in proportion to the weights."""
    return pooled * weight / pooled_weight


def access_cost(seconds: Column, walk_reluctance: float) -> Column:
    return F.floor(seconds * 100 * walk_reluctance).cast("int")


def transfer_cost(seconds: Column) -> Column:
    """Transfers on foot cost their time; no reluctance applies."""
    return (seconds * 100).cast("int")


def boarding_cost(first: Column, wait: Column, transfer_seconds: float, wait_reluctance: float) -> Column:
    return (F.when(first, FIRST_BOARD).otherwise(F.lit(transfer_seconds)) * 100 + F.floor(wait * 100 * wait_reluctance)).cast("int")


def ride_cost(seconds: Column, route_type: Column, subway_reluctance: float) -> Column:
    return F.floor(seconds * 100 * F.when(route_type.isin(*SUBWAYS), F.lit(subway_reluctance)).otherwise(F.lit(1.0))).cast("int")


def remaining_cost(seconds: Column, transfers: Column, transfer_seconds: float) -> Column:
    """What a journey costs at least from here."""
    return (seconds * 100 + transfers * int(transfer_seconds * 100)).cast("int")


def cumulative(df: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """Each distinct value with its count c and before, the number of rows with smaller values. Nulls don't count.

    Values are dealt into parts by approximate quantiles and summed up within each; only one sum for each part meets in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    shares = [i / parts for i in range(1, parts)]
    bounds = counts.agg(F.percentile_approx(value, shares, 10_000).alias("b")).first()["b"] or []
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(value))) if bounds else F.lit(0)
    dealt = counts.withColumn("part", part)
    sums = dealt.groupBy("part").agg(F.sum("c").alias("n"))
    start = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))  # `parts` rows at most
    within = F.sum("c").over(Window.partitionBy("part").orderBy(value)) - F.col("c")
    return dealt.withColumn("within", within).join(F.broadcast(start), "part").select(value, "c", (F.col("start") + F.col("within")).alias("before"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and rho, the rank correlation of two columns, equal values with their mean rank; rows with a null don't count."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    for c in "ab":
        rank = cumulative(rows, c).select(c, (F.col("before") + (F.col("c") + 1) / 2.0).alias(f"rank_{c}"))
        rows = rows.join(rank, c)
    return rows.agg(F.count("*").alias("n"), F.corr("rank_a", "rank_b").alias("rho"))
