"""Cleaning of taps, chains and places, mappings of stops and routes, checks of a feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farebox.functions.geo import haversine
from farebox.operators import spatial

#: User types that aren't analysed, the mode that isn't, and the longest ride and chain in seconds.
OTHER_USERS, OTHER_MODE, LONGEST_RIDE, LONGEST_CHAIN = (6, 7), 290, 10_800, 14_400
#: The box of the study area, and the least straight distance in metres.
BOX, LEAST_METRES = (37.0, 38.0, 126.5, 127.5), 200.0
#: How far a stop of each mode may be from its counterpart, in metres.
MAP_RADIUS = {"BUS": 50.0, "SUBWAY": 100.0}
#: The route types that a converted feed may have.
ROUTE_TYPES = (1, 2, 3, 4, 1100)


def mode_of(code: Column) -> Column:
    """The mode of a tap's code."""
    return F.when(code.between(200, 289), "SUBWAY").when(code == OTHER_MODE, "OTHER").otherwise("BUS")


def clean_taps(taps: DataFrame, area: int | None = None) -> DataFrame:
    """taps (user_type, mode, alight, ride, area) of analysed users and modes with an alighting and a possible ride; unknown values go."""
    rows = taps.where(~F.col("user_type").isin(*OTHER_USERS) & (F.col("mode") != OTHER_MODE) & F.col("alight").isNotNull() & F.col("ride").between(1, LONGEST_RIDE))
    return rows if area is None else rows.where(F.col("area") == area)


def clean_chains(chains: DataFrame) -> DataFrame:
    """chains (origin, destination, duration) of up to four hours that don't end where they began."""
    return chains.where((F.col("duration") <= LONGEST_CHAIN) & (F.col("origin") != F.col("destination")))


def located(trips: DataFrame, places: DataFrame, *ends: str) -> DataFrame:
    """trips with lat and lon of the places (place, lat, lon) at each of its ends; nulls for unknown ones."""
    for end in ends:
        trips = trips.join(places.select(F.col("place").alias(end), F.col("lat").alias(f"{end}_lat"), F.col("lon").alias(f"{end}_lon")), end, "left")
    return trips


def clean_places(trips: DataFrame, a: str, b: str) -> DataFrame:
    """Located trips whose ends are known, in the box, and not too near each other; with their distance in column straight."""
    south, north, west, east = BOX
    rows = trips
    for end in (a, b):
        rows = rows.where(F.col(f"{end}_lat").between(south, north) & F.col(f"{end}_lon").between(west, east))
    metres = haversine(F.col(f"{a}_lat"), F.col(f"{a}_lon"), F.col(f"{b}_lat"), F.col(f"{b}_lon"))
    return rows.withColumn("straight", metres).where(F.col("straight") >= LEAST_METRES)


def mapped_stops(stops: DataFrame, known: DataFrame, radius: dict[str, float] = MAP_RADIUS) -> DataFrame:
    """(id, mode, other, metres): the nearest known stop within the radius of the stop's mode; nulls without one, and for modes without a radius."""
    nothing = stops.where(F.col("mode").isNull() | ~F.col("mode").isin(*radius))
    out = nothing.select("id", "mode", F.lit(None).cast(dict(known.dtypes)["id"]).alias("other"), F.lit(None).cast("double").alias("metres"))
    for mode, metres in sorted(radius.items()):
        own = stops.where(F.col("mode") == mode)
        near = spatial.nearest(own, known, metres, 1).select("id", "other", "metres")
        out = out.union(own.select("id", "mode").join(near, "id", "left"))
    return out


def mapped_routes(names: DataFrame, routes: DataFrame, manual: DataFrame) -> DataFrame:
    """(name, route, source): the manual route (name, route) of a name, or the first of routes (route, name) called the same; nulls without one."""
    first = routes.groupBy("name").agg(F.min("route").alias("_same"))
    by_hand = manual.groupBy("name").agg(F.min("route").alias("_hand"))
    found = names.select("name").distinct().join(by_hand, "name", "left").join(first, "name", "left")
    return found.select("name", F.coalesce("_hand", "_same").alias("route"), F.when(F.col("_hand").isNotNull(), "manual").when(F.col("_same").isNotNull(), "name").alias("source"))


def converted_transfers(rows: DataFrame) -> DataFrame:
    """(src, dst, kind, seconds) of rows (src, dst, minutes as text): bad numbers and missing stops go; whole seconds, kind 2."""
    seconds = F.floor(F.col("minutes").try_cast("double") * 60).cast("int")
    return rows.select("src", "dst", F.lit(2).alias("kind"), seconds.alias("seconds")).where("src is not null and dst is not null and seconds is not null")


def transfer_summary(transfers: DataFrame) -> DataFrame:
    return transfers.agg(F.count("*").alias("n"), F.avg("seconds").alias("mean"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))


def converted_types(types: DataFrame, column: str, mapping: dict[int, int]) -> DataFrame:
    """(type, before, after): how many routes have each type before and after a mapping, which leaves other types as they are."""
    new = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)), F.col(column).cast("int")), F.col(column).cast("int"))
    both = types.select(F.explode(F.array(F.struct(F.col(column).cast("int").alias("type"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(new.alias("type"), F.lit(0).alias("b"), F.lit(1).alias("a")))).alias("x"))
    return both.groupBy("x.type").agg(F.sum("x.b").alias("before"), F.sum("x.a").alias("after"))


def feed_checks(routes: DataFrame, events: DataFrame) -> DataFrame:
    """(check, failures) of routes (route, type) and events (trip, seq as text): unknown types, sequences that are no numbers, and trips whose
    sequences don't ascend (a repeated one)."""
    types = routes.agg(F.count_if(F.col("type").isNull() | ~F.col("type").isin(*ROUTE_TYPES)).alias("failures")).select(F.lit("route_type").alias("check"), "failures")
    numbers = events.agg(F.count_if(F.col("seq").try_cast("int").isNull()).alias("failures")).select(F.lit("sequence").alias("check"), "failures")
    repeated = events.groupBy("trip", F.col("seq").try_cast("int").alias("seq")).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("failures")).select(F.lit("repeated").alias("check"), "failures")
    return types.union(numbers).union(repeated)


def unfinished(requests: DataFrame, finished: DataFrame, chunk: str = "chunk") -> DataFrame:
    """The requests whose chunk isn't among the finished ones: what a run that goes on has to do."""
    return requests.join(finished.select(chunk).distinct(), chunk, "left_anti")


def with_chunk(requests: DataFrame, key: str, size: int) -> DataFrame:
    """requests with the number of their chunk: `size` consecutive keys."""
    return requests.withColumn("chunk", F.floor(F.col(key) / size).cast("long"))


def in_order(df: DataFrame, key: str, start: str, earliest: int, limit: int) -> DataFrame:
    """For each key the first `limit` itineraries that don't start before `earliest`, in order of their start."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(start, "itinerary"))
    return df.where(F.col(start) >= earliest).withColumn("turn", turn).where(F.col("turn") <= limit)
