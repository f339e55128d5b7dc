"""Street networks from extracted ways and nodes: which ways can be walked, their edges, walks between places, ways to stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farebox.functions.geo import haversine, walk_seconds
from farebox.operators import spatial

#: Highways that can be walked, values that forbid it, and those of foot that allow it all the same.
WALKABLE = ("footway", "pedestrian", "path", "steps", "cycleway", "residential", "living_street", "tertiary", "secondary", "primary", "trunk", "unclassified", "service", "track")
FORBIDDEN = ("no", "private")
ALLOWED = ("yes", "designated")
#: Metres per second by road; others 1.2.
SPEEDS = {1.3: ("footway", "pedestrian", "path"), 0.6: ("steps",), 1.1: ("tertiary", "secondary"), 1.0: ("primary", "trunk")}
#: How much longer than the straight line a walk off the network is, and how many stops a place has.
DETOUR, MOST_STOPS = 1.3, 30


def walkable(tags: Column) -> Column:
    tag = lambda name: F.try_element_at(tags, F.lit(name))
    no = lambda name: F.coalesce(tag(name).isin(*FORBIDDEN), F.lit(False))
    yes = F.coalesce(tag("foot").isin(*ALLOWED), F.lit(False))
    return F.coalesce(tag("highway").isin(*WALKABLE), F.lit(False)) & ~no("foot") & (~no("access") | yes)


def walk_speed(road: Column) -> Column:
    out = F.lit(1.2)
    for speed, roads in SPEEDS.items():
        out = F.when(road.isin(*roads), speed).otherwise(out)
    return out


def needed_nodes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes (id, lat, lon) that walkable ways (way, nodes, tags) use: the second pass over an extract reads no other."""
    used = ways.where(walkable(F.col("tags"))).select(F.explode("nodes").alias("id")).distinct()
    return nodes.join(used, "id", "left_semi")


def edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, metres, road) of walkable ways, both ways unless tag oneway is yes. A way with an unknown node gives no edge at all."""
    road = F.try_element_at("tags", F.lit("highway"))
    oneway = F.coalesce(F.try_element_at("tags", F.lit("oneway")) == "yes", F.lit(False))
    open_ = ways.where(walkable(F.col("tags"))).select("way", road.alias("road"), oneway.alias("oneway"), F.posexplode("nodes").alias("pos", "id"))
    placed = open_.join(nodes.select("id", "lat", "lon"), "id", "left")
    of_way, order = Window.partitionBy("way"), Window.partitionBy("way").orderBy("pos")
    hops = placed.select(
        "way", "road", "oneway", F.col("id").alias("src"), "lat", "lon", F.bool_and(F.col("lat").isNotNull()).over(of_way).alias("whole"),
        *(F.lead(c).over(order).alias(f"to_{c}") for c in ("id", "lat", "lon")),
    )
    hops = hops.where("whole and to_id is not null").select("src", F.col("to_id").alias("dst"), haversine(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")).alias("metres"), "road", "oneway")
    back = hops.where("not oneway").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "metres", "road", "oneway")
    return hops.union(back).drop("oneway")


def snapped(places: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """places (id, lat, lon) with the nearest node within the radius and how far it is; nulls without one."""
    near = spatial.nearest(places, nodes, radius, 1)
    return places.join(near.select("id", F.col("other").alias("node"), F.col("metres").alias("offset")), "id", "left")


def walks(pairs: DataFrame, nodes: DataFrame, network: DataFrame, radius: float = 500.0, bound: float = 5_000.0) -> DataFrame:
    """(pair, metres) of pairs (pair, lat, lon, to_lat, to_lon): along the network, with the way to it and from it; no row without a path."""
    a = snapped(pairs.select(F.col("pair").alias("id"), "lat", "lon"), nodes, radius).select(F.col("id").alias("pair"), F.col("node").alias("source"), F.col("offset").alias("before"))
    b = snapped(pairs.select(F.col("pair").alias("id"), F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon")), nodes, radius).select(F.col("id").alias("pair"), "node", F.col("offset").alias("after"))
    cost = spatial.shortest_paths(network.select("src", "dst", F.col("metres").alias("cost")), a.where("source is not null").select("source").distinct(), bound)
    return a.join(b, "pair").join(cost, ["source", "node"]).select("pair", (F.col("before") + F.col("cost") + F.col("after")).alias("metres"))


def access_legs(places: DataFrame, stops: DataFrame, nodes: DataFrame, network: DataFrame, longest: float = 800.0, most: int = MOST_STOPS, origin_radius: float = 300.0, stop_radius: float = 300.0) -> DataFrame:
    """(id, stop, metres, seconds): the nearest stops of a place by walking distance, at most `most` of them within `longest` metres.

    From node to node along the network, with the ways to and from it. Where a place or a stop has no node near it, or no path leads
    there, the straight line counts DETOUR times; a place and a stop at one node are a straight line apart.
    """
    straight = spatial.within(places, stops, longest).select("id", F.col("other").alias("stop"), F.col("metres").alias("straight"))
    a = snapped(places, nodes, origin_radius).select("id", F.col("node").alias("source"), F.col("offset").alias("before"))
    b = snapped(stops, nodes, stop_radius).select(F.col("id").alias("stop"), "node", F.col("offset").alias("after"))
    cost = spatial.shortest_paths(network.select("src", "dst", F.col("metres").alias("cost")), a.where("source is not null").select("source").distinct(), longest)
    met = straight.join(a, "id").join(b, "stop").join(cost, ["source", "node"], "left")
    along = F.col("before") + F.col("cost") + F.col("after")
    metres = F.when(F.col("source") == F.col("node"), F.col("straight")).otherwise(F.coalesce(along, F.col("straight") * DETOUR))
    turn = F.row_number().over(Window.partitionBy("id").orderBy("metres", "stop"))
    rows = met.select("id", "stop", metres.alias("metres")).where(F.col("metres") <= longest).withColumn("_turn", turn).where(F.col("_turn") <= most)
    return rows.select("id", "stop", "metres", walk_seconds(F.col("metres")).alias("seconds"))
