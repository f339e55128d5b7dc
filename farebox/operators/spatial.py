"""Joins by distance over grid cells: equi-joins of exploded neighbour cells, then the exact distance."""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farebox.functions.geo import cell, haversine
from farebox.sources.shared import written


def within(left: DataFrame, right: DataFrame, radius: float, size: float | None = None, max_lat: float = 60.0) -> DataFrame:
    """Pairs of left (id, lat, lon) and right (id, lat, lon) at most radius metres apart: id, other, metres.

    Cells are as large as the radius reaches at latitude max_lat, so that three by three of them suffice; they go on across 180 degrees of
    longitude. A point beyond max_lat raises; a larger max_lat gives wider cells. The side that is exploded is the left one.
    """
    step = size or radius / 111_000.0 * 1.01
    columns = max(1, int(360.0 / (step / math.cos(math.radians(max_lat)))))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    known = lambda lat: F.when(F.abs(lat) > max_lat, F.raise_error(F.lit(f"a latitude is beyond {max_lat}; give a larger max_lat")).cast("double")).otherwise(lat)
    cx = lambda lon, d: F.pmod(F.floor((lon + 180.0) / (360.0 / columns)) + d, F.lit(columns)).cast("long")
    own = left.select("id", "lat", "lon", cell(known(F.col("lat")), step).alias("_y"), F.floor((F.col("lon") + 180.0) / (360.0 / columns)).alias("_x"))
    around = F.flatten(F.transform(near, lambda dy: F.transform(near, lambda dx: F.struct((F.col("_y") + dy).alias("cy"), F.pmod(F.col("_x") + dx, F.lit(columns)).cast("long").alias("cx")))))
    a = own.select("id", "lat", "lon", F.explode(around if columns > 2 else F.array_distinct(around)).alias("c")).select("id", "lat", "lon", "c.cy", "c.cx")
    b = right.select(F.col("id").alias("other"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), cell(known(F.col("lat")), step).alias("cy"), cx(F.col("lon"), F.lit(0)).alias("cx"))
    metres = haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    return a.join(b, ["cy", "cx"]).withColumn("metres", metres).where(F.col("metres") <= radius).select("id", "other", "metres")


def _parts(df: DataFrame) -> int:
    """How many parts to deal small rows over that many rows follow from; by their own size they would be one."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _place() -> Column:
    return F.struct("lat", "lon")


def nearest(left: DataFrame, right: DataFrame, radius: float, k: int) -> DataFrame:
    """The k nearest others within the radius, with their rank; ties go to the smaller id.

    Points at one place are equally far from everything: so each place of the left side is compared once, with the k smallest ids of each place of the
    right side, and what it has found goes to all ids there. Work grows with the ids and with the pairs of different places near each other.
    """
    turn = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("id"))
    few = right.select("id", "lat", "lon").withColumn("_turn", turn).where(F.col("_turn") <= k)
    places = left.select("lat", "lon").distinct().select(_place().alias("id"), "lat", "lon").repartition(_parts(left), "lat", "lon")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("metres", "other"))
    found = within(places, few, radius).withColumn("rank", rank).where(F.col("rank") <= k)
    lists = found.groupBy("id").agg(F.collect_list(F.struct("metres", "other")).alias("_l")).select("id.lat", "id.lon", "_l")
    met = left.select("id", "lat", "lon").repartition(_parts(left), "lat", "lon").join(lists, ["lat", "lon"])
    best = met.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("_l"))), 1, k).alias("_l"))  # an id may have several places
    return best.select("id", F.posexplode("_l").alias("_n", "_x")).select("id", "_x.other", "_x.metres", (F.col("_n") + 1).alias("rank"))


def transfers(stops: DataFrame, radius: float = 500.0, digits: int | None = None) -> DataFrame:
    """Footpaths between different stops within the radius; metres are rounded to digits, if given.

    Pairs of places are compared once, and then met by the stops at both ends, so only what is asked for is made of stops at one place.
    """
    places = stops.select("lat", "lon").distinct().select(_place().alias("id"), "lat", "lon")
    near = within(places, places, radius).select(F.col("id").alias("_from"), F.col("other").alias("_to"), "metres" if digits is None else F.round("metres", digits).alias("metres"))
    starts = stops.select("id", _place().alias("_from")).join(near, "_from").repartition(_parts(stops), "_to")
    return starts.join(stops.select(F.col("id").alias("other"), _place().alias("_to")), "_to").where("id <> other").select("id", "other", "metres")


def shortest_paths(edges: DataFrame, sources: DataFrame, bound: float, rounds: int | None = None) -> DataFrame:
    """(source, node, cost) of every node reached: nodes whose cost is at most bound are expanded, others are ends.

    Bellman-Ford in rounds over edges (src, dst, cost); only what a round has improved goes on. Each round is written, so the plan
    doesn't grow. Costs aren't negative, so the rounds end by themselves; if rounds are given and
    don't suffice, that is an error.
    """
    if not edges.where("cost < 0").isEmpty():
        raise ValueError("an edge has a negative cost")
    edges = written(edges.select("src", "dst", "cost").groupBy("src", "dst").agg(F.min("cost").alias("cost")), "edges")
    best = written(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost")), "best")
    front = best
    for done in count():
        hop = front.where(F.col("cost") <= bound).select("source", F.col("node").alias("src"), F.col("cost").alias("so_far")).join(edges, "src")
        hop = hop.select("source", F.col("dst").alias("node"), (F.col("so_far") + F.col("cost")).alias("new"), F.lit(None).cast("double").alias("cost"))
        # hops and what is known meet in one aggregation, which gives both the new state and what has improved
        both = hop.union(best.select("source", "node", F.lit(None).cast("double"), "cost")).groupBy("source", "node").agg(F.min("new").alias("new"), F.min("cost").alias("cost"))
        better = F.col("cost").isNull() | (F.col("new") < F.col("cost"))
        state = written(both.select("source", "node", F.least("cost", "new").alias("cost"), F.coalesce(better, F.lit(False)).alias("better")), "best")
        best, front = state.select("source", "node", "cost"), state.where("better").select("source", "node", "cost")
        if front.isEmpty():
            return best
        if rounds is not None and done + 1 >= rounds:
            raise RuntimeError(f"paths aren't complete after {rounds} rounds")
