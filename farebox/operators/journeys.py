"""From taps to journeys: sessions by gaps, chains, demand by time of day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sessions(taps: DataFrame, card: str = "card", at: str = "at", tie: str = "tap_id", gap: int = 3600, start: Column | None = None) -> DataFrame:
    """taps with the number of their journey within the card: a new one begins after a gap of more than gap seconds or where start holds."""
    order = Window.partitionBy(card).orderBy(at, tie)
    before = F.lag(at).over(order)
    new = before.isNull() | (F.col(at) - before > gap)
    if start is not None:
        new = new | F.coalesce(start, F.lit(False))
    return taps.withColumn("journey", F.sum(new.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def chains(taps: DataFrame, card: str = "card", at: str = "at", tie: str = "tap_id", place: str = "place") -> DataFrame:
    """One row for each journey: first and last place, legs, duration. All sides combine before the shuffle."""
    order = F.struct(at, tie)
    return taps.groupBy(card, "journey").agg(
        F.count("*").alias("legs"), F.min_by(place, order).alias("origin"), F.max_by(place, order).alias("destination"),
        F.min(at).alias("start"), (F.max(at) - F.min(at)).alias("duration"),
    )


def demand(trips: DataFrame, *by: str, at: str = "at", seconds: int = 900) -> DataFrame:
    """Trips by the given columns and quarter of an hour."""
    return trips.groupBy(*by, F.floor(F.col(at) / seconds).cast("long").alias("bucket")).agg(F.count("*").alias("trips"))


def right_closed(value: Column, edges: list[float]) -> Column:
    """The number of the bin (edges[i], edges[i + 1]] from 0, null outside; the lowest edge belongs to no bin."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        out = F.when((value > edges[i]) & (value <= edges[i + 1]), i).otherwise(out)
    return out


def left_closed(value: Column, edges: list[float]) -> Column:
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        out = F.when((value >= edges[i]) & (value < edges[i + 1]), i).otherwise(out)
    return out


def index_percentiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: the value at place int(n * share) from 0 of the sorted values; nulls without any."""
    from farebox.operators.quantiles import values_at

    places = {name: (lambda n, s=s: F.least(F.floor(n * F.lit(s)), n - 1)) for name, s in shares.items()}
    return values_at(df, [], value, places).agg(*(F.max(name).alias(name) for name in places))


def chain_lists(legs: DataFrame, *columns: str, by: str = "chain_id", order: str = "leg") -> DataFrame:
    """One row for each chain: its legs less one as transfers, and the values of each column in the order of its legs, nulls in their places."""
    listed = legs.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_at"), *columns))).alias("_l"))
    return listed.select(by, (F.size("_l") - 1).alias("transfers"), *(F.col("_l")[c].alias(c) for c in columns))
