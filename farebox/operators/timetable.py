"""Timetables as tables of stop events (trip, route, pos, stop, arr, dep), and what is asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farebox.sources.shared import written

#: Seconds of a slice of departures.
SLICE = 1800
#: Departures made from one row.
MADE = 4096


def service_window(events: DataFrame) -> DataFrame:
    """One row: the first departure and the last arrival; -1 is missing, four and twenty-six o'clock stand for none."""
    known = lambda c: F.when(F.col(c) >= 0, F.col(c))
    return events.agg(F.coalesce(F.min(known("dep")), F.lit(14_400)).alias("first_dep"), F.coalesce(F.max(known("arr")), F.lit(93_600)).alias("last_arr"))


def patterns(events: DataFrame) -> DataFrame:
    """Trips of a route with the same stops in the same order form a pattern: route, stops, trips, first_trip."""
    trips = events.groupBy("route", "trip").agg(F.sort_array(F.collect_list(F.struct("pos", "stop"))).alias("_s"))
    stops = F.concat_ws(",", F.transform("_s", lambda s: s.stop.cast("string")))
    return trips.groupBy("route", stops.alias("stops")).agg(F.count("*").alias("trips"), F.min("trip").alias("first_trip"))


def routes_by_stop(events: DataFrame) -> DataFrame:
    return events.groupBy("stop").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_set("route")), lambda r: r.cast("string"))).alias("routes"), F.countDistinct("route").alias("n_routes"))


def as_of(queries: DataFrame, events: DataFrame, key: str, forward: bool = True, slice_seconds: int = 3600) -> DataFrame:
    """For each query (query_id, key, at) the event (key, event_id, at) that is next (or latest, if not forward) at its time, ties to the
    smaller event_id; queries without one have nulls.

    No pairs are made: queries and events are sorted together within a key and a slice of time, and the nearest event is carried along. A
    query without one in its slice takes the first (or last) event of the next slice that has any, from a table of one row for each
    key and slice. So a key's rows are dealt over as many tasks as it has slices.
    """
    in_slice = lambda: F.floor(F.col("at") / slice_seconds).alias("slice")
    q = queries.select(key, "at", "query_id", in_slice(), F.lit(None).cast("struct<at:bigint,event_id:bigint>").alias("e"))
    one = F.struct(F.col("at").cast("long").alias("at"), F.col("event_id").cast("long").alias("event_id"))
    e = events.select(key, "at", F.lit(None).cast("long").alias("query_id"), in_slice(), one.alias("e"))
    order = [F.desc("at") if forward else "at", F.col("query_id").isNotNull(), F.desc("e.event_id")]
    own = Window.partitionBy(key, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = q.unionByName(e).withColumn("own", F.last("e", ignorenulls=True).over(own)).where("query_id is not null")
    # the event of each slice that the slices before (or after) it look for, carried over slices without any
    edge = F.min(F.struct("at", "event_id")) if forward else F.max_by(F.struct("at", "event_id"), F.struct(F.col("at"), -F.col("event_id")))
    edges = events.select(key, in_slice(), F.col("at").cast("long").alias("at"), F.col("event_id").cast("long").alias("event_id")).groupBy(key, "slice").agg(edge.alias("edge"))
    asked = queries.select(key, in_slice()).distinct().join(edges, [key, "slice"], "full")
    side = Window.partitionBy(key).orderBy(F.desc("slice") if forward else "slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = asked.select(F.col(key).alias("_key"), F.col("slice").alias("_slice"), F.last("edge", ignorenulls=True).over(side).alias("carried"))
    met = found.join(carried, (F.col(key) == F.col("_key")) & (F.col("slice") == F.col("_slice")), "left")
    e = F.coalesce("own", "carried")
    return met.select("query_id", key, "at", e.event_id.alias("event_id"), e.at.alias("event_at"))


def earliest_arrivals(events: DataFrame, footpaths: DataFrame, origins: DataFrame, boardings: int = 4, slack: int = 60) -> DataFrame:
    """(origin, stop, boardings, arr): the earliest arrival at each stop with each number of boardings, if it is earlier than with fewer.

    Rounds of joins: board the earliest trip of each route that leaves a stop late enough, ride to all later stops, walk on. Only
    stops that a round has improved are boarded in the next. The timetable is written once, and of each round what it has improved.

    A departure is found by an equi-join: it is the one to board for arrivals after the departure before it, up to its own time, and stands in
    each slice of SLICE seconds that this interval meets. So a stop's arrival meets the departures of one slice, not those of the day.
    """
    front = written(origins.select("origin", F.col("origin").alias("stop"), F.lit(0).alias("boardings"), F.col("at").alias("arr")), "round")
    out = front
    each = events.groupBy("stop", "route", "pos", "dep").agg(F.min("trip").alias("trip"))
    covered = each.withColumn("before", F.coalesce(F.lag("dep").over(Window.partitionBy("stop", "route", "pos").orderBy("dep")), F.lit(-1)))
    slices = F.sequence(F.floor((F.col("before") + 1) / SLICE), F.floor(F.col("dep") / SLICE))
    boards = written(covered.where("dep >= 0").select("stop", "route", "pos", "dep", "trip", "before", F.explode(slices).alias("slice")), "boards")
    rides = written(events.select("trip", F.col("pos").alias("to"), "stop", "arr"), "rides")
    for n in range(1, boardings + 1):
        ready = front.select("origin", "stop", (F.col("arr") + F.lit(0 if n == 1 else slack)).alias("ready"))
        met = ready.withColumn("slice", F.floor(F.col("ready") / SLICE)).join(boards, ["stop", "slice"]).where("before < ready and ready <= dep")
        board = met.groupBy("origin", "route", "pos").agg(F.min(F.struct("dep", "trip")).alias("b"))
        board = board.groupBy("origin", F.col("b.trip").alias("trip")).agg(F.min("pos").alias("pos"))
        ride = board.join(rides, "trip").where("to > pos").groupBy("origin", "stop").agg(F.min("arr").alias("arr"))
        walk = ride.join(footpaths, ride.stop == footpaths.src).select("origin", F.col("dst").alias("stop"), (F.col("arr") + F.col("seconds")).alias("arr"))
        # new arrivals and those known so far meet in one aggregation; what is known comes last among equals
        none = F.lit(None).cast("long")
        both = ride.union(walk).select("origin", "stop", F.col("arr").cast("long").alias("arr"), none.alias("old")).union(out.select("origin", "stop", none, F.col("arr").cast("long")))
        least = both.groupBy("origin", "stop").agg(F.min("arr").alias("arr"), F.min("old").alias("old"))
        front = written(least.where("arr is not null and (old is null or arr < old)").select("origin", "stop", F.lit(n).alias("boardings"), "arr"), "round")
        if front.isEmpty():
            break
        out = out.union(front)
    return out


def pareto_front(df: DataFrame, key: str, *costs: str) -> DataFrame:
    """The rows that no other row of their key dominates (at most as large everywhere and smaller somewhere). Rows are compared within a
    key only after equal ones are one, and only with those that lead in the first cost."""
    unique = df.select(key, *costs).distinct()
    if len(costs) == 2:
        # in order of both costs, a row is dominated if one before it isn't larger in the second
        before = Window.partitionBy(key).orderBy(*costs).rowsBetween(Window.unboundedPreceding, -1)
        least = unique.withColumn("_least", F.min(costs[1]).over(before))
        return df.join(least.where(F.col("_least").isNull() | (F.col("_least") > F.col(costs[1]))).select(key, *costs), [key, *costs], "left_semi")
    other = unique.select(key, *(F.col(c).alias(f"_{c}") for c in costs))
    same, less = F.lit(True), F.lit(False)
    for c in costs:
        same, less = same & (F.col(f"_{c}") <= F.col(c)), less | (F.col(f"_{c}") < F.col(c))
    a, b = unique.alias("a"), other.alias("b")
    kept = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & same & less, "left_anti")
    return df.join(kept, [key, *costs], "left_semi")


def thinned(trips: DataFrame, factor: float) -> DataFrame:
    """Headways longer by a factor of at least 1: of the n trips (route, turn from 0) of a route, ceil(n / factor) evenly chosen ones."""
    n = F.count("*").over(Window.partitionBy("route"))
    kept = trips.withColumn("_n", n).withColumn("_m", F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(factor))).cast("int"))
    first = F.floor(F.col("turn") / F.lit(factor)).cast("int")
    picks = [F.least(F.floor(i * F.lit(factor) + 0.5).cast("int"), F.col("_n") - 1) == F.col("turn") for i in (first - 1, first, first + 1)]
    valid = [(i >= 0) & (i < F.col("_m")) for i in (first - 1, first, first + 1)]
    hit = F.lit(False)
    for p, v in zip(picks, valid, strict=True):
        hit = hit | (p & v)
    return kept.where(hit).drop("_n", "_m")


def _departures(span: DataFrame, factor: float, *columns: str) -> DataFrame:
    """Rows of span (route, n, first, last and columns), one for each MADE of the ceil(n / factor) departures of a route: columns, first, headway, and
    the turns since and until; a route of one trip has one."""
    m = F.when(F.col("n") > 1, F.ceil(F.col("n") / F.lit(factor))).otherwise(1).cast("int")
    headway = F.floor((F.col("last") - F.col("first")) / F.greatest(m - 1, F.lit(1))).cast("int")
    rows = span.select("route", "first", *columns, headway.alias("headway"), m.alias("m"), F.explode(F.sequence(F.lit(0), m - 1, F.lit(MADE))).alias("since"))
    return rows.withColumn("until", F.least(F.col("since") + (MADE - 1), F.col("m") - 1)).drop("m")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows with each turn of their departures, dealt over the tasks before they become many.

    Spark takes rows that are made by explode to be as few as those they come from, and would broadcast them; so nothing may join them after this.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    dealt = rows.repartition(parts, "route", "since", *keys)
    return dealt.select("*", F.explode(F.sequence("since", "until")).alias("turn")).withColumn("dep", F.col("first") + F.col("turn") * F.col("headway"))


def interpolated(trips: DataFrame, factor: float) -> DataFrame:
    """Headways shorter by a factor below 1: ceil(n / factor) departures at an even headway in whole seconds over each route's span."""
    span = trips.groupBy("route").agg(F.count("*").alias("n"), F.min("dep").alias("first"), F.max("dep").alias("last"))
    return _dealt(_departures(span, factor)).select("route", "turn", "dep")


def added_routes(routes: DataFrame, stops: DataFrame, dwell: int = 30, missing: int = 300) -> DataFrame:
    """The stop events (route, turn, pos, stop, arr, dep) of new routes: routes (route, first, last, headway), a trip every headway seconds, the last
    one included; stops (route, pos, stop, leg): leg is the ride from the stop before in seconds, `missing` where it isn't given.

    Offsets are a sum along each route, departures an explosion of its row; both meet by route. Routes without stops have no events.
    """
    along = Window.partitionBy("route").orderBy("pos")
    ride = F.when(F.row_number().over(along) == 1, 0).otherwise(F.coalesce("leg", F.lit(missing)))
    timed = stops.withColumns({"_ride": ride, "_n": F.row_number().over(along) - 1})
    offsets = timed.select("route", "pos", "stop", (F.sum("_ride").over(along) + F.col("_n") * dwell).alias("offset"))
    starts = routes.select("route", F.posexplode(F.when(F.col("last") >= F.col("first"), F.sequence("first", "last", "headway"))).alias("turn", "start"))
    arr = F.col("start") + F.col("offset")
    return starts.join(offsets, "route").select("route", "turn", "pos", "stop", arr.alias("arr"), (arr + dwell).alias("dep"))


def overlay(base: DataFrame, disabled: DataFrame, changed: DataFrame, added: DataFrame, key: str = "route") -> DataFrame:
    """A scenario's timetable: base without disabled and changed routes, with the changed ones (unless disabled) and the added ones."""
    gone = disabled.select(key).union(changed.select(key)).distinct()
    now = changed.join(disabled.select(key), key, "left_anti")
    return base.join(gone, key, "left_anti").unionByName(now).unionByName(added)


def _turned(events: DataFrame) -> DataFrame:
    """The trips of each route (route, trip, turn, dep0), numbered from 0 by their first departure."""
    first = events.groupBy("route", "trip").agg(F.min_by("dep", "pos").alias("dep0"))
    return first.withColumn("turn", (F.row_number().over(Window.partitionBy("route").orderBy("dep0", "trip")) - 1).cast("int"))


def thinned_trips(events: DataFrame, factor: float) -> DataFrame:
    """The stop events (route, trip, pos, stop, arr, dep) of the trips that `thinned` keeps, whole and as they are."""
    return events.join(thinned(_turned(events), factor).select("route", "trip"), ["route", "trip"], "left_semi")


def interpolated_trips(events: DataFrame, factor: float) -> DataFrame:
    """Stop events (route, turn, pos, stop, arr, dep) of new trips at the departures that `interpolated` gives.

    They ride and dwell like the first trip of their route, starting without a dwell and ending with none; a route of one trip keeps it.
    """
    trips = events.groupBy("route", "trip").agg(F.min_by("dep", "pos").alias("dep0"))
    span = trips.groupBy("route").agg(F.count("*").alias("n"), F.min("dep0").alias("first"), F.max("dep0").alias("last"), F.min(F.struct("dep0", "trip")).alias("_lead"))
    model = events.join(span.select("route", F.col("_lead.trip").alias("trip"), F.col("_lead.dep0").alias("dep0"), (F.col("n") == 1).alias("one")), ["route", "trip"])
    of_route = Window.partitionBy("route")
    at_start, at_end = F.col("pos") == F.min("pos").over(of_route), F.col("pos") == F.max("pos").over(of_route)
    own = lambda c: F.col(c) - F.col("dep0")
    model = model.select("route", "pos", "stop", F.when(at_start & ~F.col("one"), 0).otherwise(own("arr")).alias("a"), F.when(at_end & ~F.col("one"), F.when(at_start, 0).otherwise(own("arr"))).otherwise(own("dep")).alias("d"))
    made = _dealt(_departures(span, factor).join(model, "route"), "pos")
    return made.select("route", "turn", "pos", "stop", (F.col("dep") + F.col("a")).alias("arr"), (F.col("dep") + F.col("d")).alias("dep"))


def edited(base: DataFrame, edits: DataFrame, key: str = "route") -> DataFrame:
    """base (routes with a value) after an ordered list of edits (position, route, action, value): for each route the last one counts.

    Actions: disable drops the route, change sets its value if it exists, add sets it whether or not it does.
    """
    last = edits.groupBy(key).agg(F.max_by(F.struct("action", "value"), "position").alias("e"))
    met = base.select(key, F.col("value").alias("_old"), F.lit(True).alias("_is")).join(last, key, "full")
    value = F.when(F.col("e").isNull(), F.col("_old")).otherwise(F.col("e.value"))
    kept = F.when(F.col("e").isNull(), True).when(F.col("e.action") == "disable", False).when(F.col("e.action") == "change", F.coalesce("_is", F.lit(False))).otherwise(True)
    return met.where(kept).select(key, value.alias("value"))


def compared(base: DataFrame, scenario: DataFrame, key: str = "request", order: str = "place") -> DataFrame:
    """For each request of base the difference that a scenario makes: itineraries (their number), minutes and transfers of the first one, and change
    (better, worse, same, or lost without any). Both: request, place, seconds, transfers. Each side is one row a request before they are joined."""
    first = lambda df, x: df.groupBy(key).agg(F.min_by(F.struct("seconds", "transfers"), F.struct(order, "seconds", "transfers")).alias(f"f{x}"), F.count("*").alias(f"n{x}"))
    met = first(base, 0).join(first(scenario, 1), key, "left")
    seconds = F.col("f1.seconds") - F.col("f0.seconds")
    change = F.when(F.col("n1").isNull(), "lost").when(seconds < 0, "better").when(seconds > 0, "worse").otherwise("same")
    return met.select(key, (F.coalesce("n1", F.lit(0)) - F.col("n0")).alias("itineraries"), (seconds / 60).alias("minutes"), (F.col("f1.transfers") - F.col("f0.transfers")).alias("transfers"), change.alias("change"))
