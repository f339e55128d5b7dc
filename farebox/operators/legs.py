"""Legs: journeys put together from walks and rides, the places of a ride on its route, lists of stops with all visits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.functions.geo import WALK_SPEED

#: Fixed value: what a second on foot costs in the units of a second's ride.
WALK_COST = 2
_KINDS = ("access", "transit", "transfer", "egress")


def _place(name: Column, lat: Column, lon: Column, stop: Column) -> Column:
    return F.struct(name.alias("name"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), stop.alias("stop"))


def leg(kind: str, start: Column, seconds: Column, key: str, src: Column | None = None, dst: Column | None = None, lat: Column | None = None, lon: Column | None = None, mode: Column | None = None, route: Column | None = None) -> Column:
    """A leg as put_together takes it. kind: access, transit, transfer or egress; src and dst: stops (of type key) that it has; lat and lon: the origin
    or the destination; mode and route of a ride."""
    none = lambda kind: F.lit(None).cast(kind)
    end = none("struct<name:string,lat:double,lon:double>")
    if kind in ("access", "egress"):
        end = F.struct(F.lit("Origin" if kind == "access" else "Destination").alias("name"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))
    return F.struct(
        F.lit(_KINDS.index(kind)).alias("kind"), start.cast("long").alias("start"), seconds.cast("long").alias("seconds"), (none(key) if src is None else src.cast(key)).alias("src"),
        (none(key) if dst is None else dst.cast(key)).alias("dst"), end.alias("end"), (F.lit("WALK") if mode is None else mode).alias("mode"), (none("string") if route is None else route.cast("string")).alias("route"),
    )


def assembled(access: DataFrame, transit: DataFrame, transfers: DataFrame, egress: DataFrame, stops: DataFrame) -> DataFrame:
    """One row for each request: its legs in their order, as an array of structs and as JSON, with totals.

    access (request, start, seconds, stop, lat, lon) walks from the origin to a stop, egress (the same) from a stop to the destination; transit (request,
    start, seconds, src, dst, mode, route) rides and transfers (request, start, seconds, src, dst) walks between stops; stops (stop, name,
    lat, lon). All become rows of one shape, which put_together takes.
    """
    key, c = dict(stops.dtypes)["stop"], F.col
    start, seconds = c("start"), c("seconds")
    each = [
        access.select("request", leg("access", start, seconds, key, dst=c("stop"), lat=c("lat"), lon=c("lon")).alias("leg")),
        transit.select("request", leg("transit", start, seconds, key, c("src"), c("dst"), mode=c("mode"), route=c("route")).alias("leg")),
        transfers.select("request", leg("transfer", start, seconds, key, c("src"), c("dst")).alias("leg")),
        egress.select("request", leg("egress", start, seconds, key, src=c("stop"), lat=c("lat"), lon=c("lon")).alias("leg")),
    ]
    return put_together(reduce(DataFrame.unionByName, each), stops)


def put_together(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """One row for each request of rows (request, leg), as assembled gives it.

    Legs meet the places of their ends (stop, name, lat, lon) in two joins, and one aggregation by request sorts and sums them; rows that are dealt by
    request stay where they are, if the stops are few enough to be sent to the tasks. Legs are in order of start, at one start in the order access,
    transit, transfer, egress; an unknown stop has no name and place, a null start comes first. A request has the legs that there are;
    requests without any have no row.
    """
    all_legs = rows.select("request", "leg.*")
    for end in ("src", "dst"):
        found = stops.select(F.col("stop").alias(end), F.struct("name", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).alias(f"at_{end}"))
        all_legs = all_legs.join(found, end, "left")
    walked = F.col("kind") != _KINDS.index("transit")
    origin, target = F.when(F.col("kind") == 0, F.col("end")).otherwise(F.col("at_src")), F.when(F.col("kind") == 3, F.col("end")).otherwise(F.col("at_dst"))
    told = F.struct(
        F.col("start"), F.col("kind"), F.col("mode"), (F.col("start") + F.col("seconds")).alias("end"), F.col("seconds").alias("duration"),
        F.when(walked, F.round(F.col("seconds") * WALK_SPEED, 2)).otherwise(0.0).alias("distance"),
        (F.col("seconds") * F.when(walked, WALK_COST).otherwise(1)).alias("cost"),
        _place(origin.getField("name"), origin.getField("lat"), origin.getField("lon"), F.col("src")).alias("from"),
        _place(target.getField("name"), target.getField("lat"), target.getField("lon"), F.col("dst")).alias("to"), F.col("route"),
    )
    listed = all_legs.groupBy("request").agg(
        F.sort_array(F.collect_list(told)).alias("legs"), F.sum(F.when(walked, F.col("seconds")).otherwise(0)).alias("walk_seconds"),
        F.sum(F.when(walked, 0).otherwise(F.col("seconds"))).alias("ride_seconds"), F.count_if(~walked).alias("rides"),
        F.min("start").alias("start"), F.max(F.col("start") + F.col("seconds")).alias("end"),
    )
    fields = ["mode", "start", "end", "duration", "distance", "cost", "from", "to", "route"]
    legs = F.transform("legs", lambda x: F.struct(*(x.getField(f).alias(f) for f in fields)))
    modes = F.transform(F.filter("legs", lambda x: x.kind == 1), lambda x: x.mode)
    told = listed.withColumns({"legs": legs, "modes": modes, "transfers": F.greatest(F.col("rides") - 1, F.lit(0))})
    return told.withColumn("json", F.to_json(F.struct(F.col("request").alias("id"), "start", "end", "legs"), {"ignoreNullFields": "false"}))


def route_positions(stops: DataFrame) -> DataFrame:
    """An inverted index of routes (route, pos, stop): for each route and stop all its places in order, a loop's second visit too."""
    return stops.groupBy("route", "stop").agg(F.sort_array(F.collect_list("pos")).alias("places"))


def visits_by_stop(stops: DataFrame) -> DataFrame:
    """For each stop its visits (route, pos) in order; a route that comes twice is listed twice."""
    return stops.groupBy("stop").agg(F.sort_array(F.collect_list(F.struct("route", "pos"))).alias("visits"))


def leg_positions(legs: DataFrame, stops: DataFrame) -> DataFrame:
    """legs (route, board, alight) with status, at and to, the places of boarding and alighting on the route (route, pos, stop).

    Both ends meet the inverted index by route and stop. Of all visits the shortest ride counts, the first one of several; where no alighting
    follows a boarding, the ride goes past the end of a circular route: from the last boarding to the first alighting. Status: no_route,
    board_not_found, alight_not_found or ok. Null routes and stops are never found.
    """
    index = route_positions(stops)
    known = stops.select("route").where("route is not null").distinct().withColumn("_known", F.lit(True))
    met = legs.join(known, "route", "left")
    for end, name in (("board", "_b"), ("alight", "_a")):
        met = met.join(index.select("route", F.col("stop").alias(end), F.col("places").alias(name)), ["route", end], "left")
    pairs = F.flatten(F.transform("_b", lambda b: F.transform(F.slice(F.filter("_a", lambda a: a >= b), 1, 1), lambda a: F.struct((a - b).alias("long"), b.alias("at"), a.alias("to")))))
    best = F.array_min(pairs)
    past = F.struct(F.lit(None).cast("long").alias("long"), F.array_max("_b").alias("at"), F.array_min("_a").alias("to"))
    status = F.when(F.col("_known").isNull(), "no_route").when(F.col("_b").isNull(), "board_not_found").when(F.col("_a").isNull(), "alight_not_found").otherwise("ok")
    ride = F.coalesce(F.struct(best.at.alias("at"), best.to.alias("to")), F.struct(past.at.alias("at"), past.to.alias("to")))
    ride = F.when(best.isNotNull(), ride).otherwise(F.struct(past.at.alias("at"), past.to.alias("to")))
    told = met.withColumn("status", status).withColumn("_r", F.when(F.col("status") == "ok", ride))
    return told.select(*legs.columns, "status", F.col("_r.at").alias("at"), F.col("_r.to").alias("to"))


def traversed_stops(placed: DataFrame, stops: DataFrame) -> DataFrame:
    """placed legs (route, status, at, to) with the stops in between, both ends included; empty where there is no ride."""
    routes = stops.groupBy("route").agg(F.sort_array(F.collect_list(F.struct("pos", "stop"))).alias("_s"))
    met = placed.join(routes, "route", "left")
    ahead, tail, head = (F.filter("_s", f) for f in (lambda s: (s.pos >= F.col("at")) & (s.pos <= F.col("to")), lambda s: s.pos >= F.col("at"), lambda s: s.pos <= F.col("to")))
    ride = F.when(F.col("at") <= F.col("to"), ahead).otherwise(F.concat(tail, head))
    some = F.when((F.col("status") == "ok"), F.transform(ride, lambda s: s.stop))
    return met.withColumn("stops", F.coalesce(some, F.slice(F.transform(F.coalesce("_s", F.array().cast(dict(routes.dtypes)["_s"])), lambda s: s.stop), 1, 0))).drop("_s")
