"""Queries on sequences, journeys, distances and timetables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farebox.functions import arrays, geo, text, times
from farebox.operators import journeys, quantiles, spatial
from farebox.operators import timetable as tt
from farebox.plans.derive import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# Sequences: the parts of an order are a journey's stops, a customer's next order is the journey to compare it with.
_SEQ_SQL = """stops AS (SELECT l_orderkey, list((l_partkey % 7)::BIGINT ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS s FROM lineitem GROUP BY 1),
 o AS (SELECT o_orderkey, o_totalprice, lead(o_orderkey) OVER w AS next, lead(o_totalprice) OVER w AS next_price FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
 seq AS (SELECT o_orderkey AS chain_id, coalesce(a.s, []) AS a, coalesce(b.s, []) AS b, o_totalprice AS ta, next_price AS tb FROM o LEFT
  JOIN stops a ON a.l_orderkey = o_orderkey LEFT JOIN stops b ON b.l_orderkey = next WHERE next IS NOT NULL)"""


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    stops = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(order)).alias("s"))
    stops = stops.select("l_orderkey", F.transform("s", lambda x: x.l_partkey % 7).alias("s"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lead("o_orderkey").over(w).alias("next"), F.lead("o_totalprice").over(w).alias("next_price")).where("next is not null")
    a = stops.select(F.col("l_orderkey").alias("o_orderkey"), F.col("s").alias("a"))
    b = stops.select(F.col("l_orderkey").alias("next"), F.col("s").alias("b"))
    none = F.array().cast("array<bigint>")
    return o.join(a, "o_orderkey", "left").join(b, "next", "left").select(F.col("o_orderkey").alias("chain_id"), F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"), F.col("o_totalprice").alias("ta"), F.col("next_price").alias("tb"))


@query(f"""WITH RECURSIVE {_SEQ_SQL},
 m AS (SELECT chain_id, i.i, j.j FROM seq, range(1, 20) i(i), range(1, 20) j(j) WHERE i.i <= len(a) AND j.j <= len(b) AND a[i.i] = b[j.j]),
 c AS (SELECT chain_id, i, j, 1 AS n FROM m UNION SELECT m.chain_id, m.i, m.j, c.n + 1 FROM c JOIN m ON m.chain_id = c.chain_id AND m.i > c.i AND m.j > c.j)
 SELECT chain_id, CAST(coalesce(max(n), 0) AS BIGINT) AS lcs, round(CASE WHEN len(any_value(a)) = 0 AND len(any_value(b)) = 0 THEN 1
  WHEN len(any_value(a)) = 0 OR len(any_value(b)) = 0 THEN 0
  ELSE 2.0 * coalesce(max(n), 0) / (len(any_value(a)) + len(any_value(b))) END, 6) AS similarity
 FROM seq LEFT JOIN c USING (chain_id) GROUP BY chain_id""")
def lcs_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _sequences(spark, sf_dir).select("chain_id", arrays.lcs_length(a, b).cast("long").alias("lcs"), r6(arrays.lcs_similarity(a, b), "similarity"))


@query(f"""WITH {_SEQ_SQL}, x AS (SELECT *, len(list_intersect(a, b)) AS both_, len(list_distinct(list_concat(a, b))) AS any_ FROM seq)
 SELECT chain_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE both_ / any_ END, 6) AS jaccard,
  round(len(list_filter(list_zip(a[:least(len(a), len(b))], b[:least(len(a), len(b))]), lambda p: p[1] = p[2])) * 2 / (2.0 * greatest(len(a), len(b), 1)), 6) AS pair_rate,
  round(CASE WHEN ta <= 0 OR tb <= 0 THEN 0 ELSE 1 - least(1, abs(ta - tb) / greatest(ta, tb)) END, 6) AS time_sim, CASE WHEN a = b THEN 1 ELSE 0 END AS equal FROM x""")
def sequence_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _sequences(spark, sf_dir).select("chain_id", r6(arrays.jaccard(a, b), "jaccard"), r6(arrays.pair_match_rate(a, a, b, b), "pair_rate"), r6(arrays.time_similarity(F.col("ta"), F.col("tb")), "time_sim"), (a == b).cast("int").alias("equal"))


@query(f"""WITH {_SEQ_SQL}, x AS (SELECT chain_id, list_distinct_sorted.a AS r, len(list_distinct_sorted.a) AS n, chain_id % 7 AS f,
  (chain_id // 7) % 7 AS t FROM (SELECT chain_id, list_sort(list_distinct(a)) AS a FROM seq) list_distinct_sorted),
 p AS (SELECT *, coalesce(list_position(r, f), 0) AS i, coalesce(list_position(r, t), 0) AS j FROM x),
 q AS (SELECT chain_id, CASE WHEN i = 0 THEN 'board_not_found' WHEN j = 0 THEN 'alight_not_found' ELSE 'ok' END AS status, CASE
  WHEN i = 0 OR j = 0 THEN [] WHEN i <= j THEN r[i:j] ELSE list_concat(r[i:], r[:j]) END AS s FROM p)
 SELECT chain_id, status, array_to_string(s, ',') AS stops, len(s) AS n FROM q""")
def circular_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stops that a ride on a circular route passes."""
    route = F.array_sort(F.array_distinct("a"))
    ride = arrays.traversed(route, F.col("chain_id") % 7, F.floor(F.col("chain_id") / 7) % 7)
    return _sequences(spark, sf_dir).select("chain_id", ride.alias("r")).select("chain_id", "r.status", F.concat_ws(",", F.col("r.stops").cast("array<string>")).alias("stops"), F.size("r.stops").cast("long").alias("n"))


# Journeys: the events of a user are taps.
_TAPS_SQL = """taps AS (SELECT user_id, event_id, event_type, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS sec, value FROM events),
 g AS (SELECT *, CASE WHEN lag(sec) OVER w IS NULL OR sec - lag(sec) OVER w > 3600 THEN 1 ELSE 0 END AS new FROM taps WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)),
 j AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS journey FROM g)"""


def _taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"), "value")


@query(f"WITH {_TAPS_SQL} SELECT user_id, event_id, journey FROM j")
def sessionize_60min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journeys.sessions(_taps(spark, sf_dir), "user_id", "at", "event_id").select("user_id", "event_id", "journey")


@query(f"WITH {_TAPS_SQL} SELECT user_id, journey, count(*) AS legs, arg_min(event_type, (sec, event_id)) AS origin, arg_max(event_type, (sec, event_id)) AS destination, min(sec) AS start, max(sec) - min(sec) AS duration FROM j GROUP BY user_id, journey")
def chain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journeys.chains(journeys.sessions(_taps(spark, sf_dir), "user_id", "at", "event_id"), "user_id", "at", "event_id", "event_type")


@query(f"WITH {_TAPS_SQL} SELECT event_type, sec % 86400 // 900 AS bucket, count(*) AS trips FROM taps GROUP BY 1, 2")
def od_15min_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journeys.demand(_taps(spark, sf_dir).withColumn("at", F.col("at") % 86_400), "event_type")


@query(f"WITH {_TAPS_SQL}, h AS (SELECT sec % 86400 // 3600 AS hour FROM taps) SELECT hour, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, CASE WHEN hour IN (7, 8, 18, 19) THEN 1 ELSE 0 END AS peak, CASE WHEN hour = 23 OR hour <= 5 THEN 1 ELSE 0 END AS night FROM h GROUP BY hour")
def hour_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _taps(spark, sf_dir).groupBy(F.floor(F.col("at") % 86_400 / 3600).alias("hour")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return rows.select("hour", "n", r6(share, "share"), times.is_peak(F.col("hour") * 3600).cast("int").alias("peak"), ((F.col("hour") == 23) | (F.col("hour") <= 5)).cast("int").alias("night"))


_EDGES = [0, 20, 40, 60, 80, 100]


@query("SELECT bin, count(*) AS n FROM (SELECT CASE WHEN value > 0 AND value <= 100 THEN CAST(ceil(value / 20) - 1 AS INT) END AS bin FROM events) GROUP BY bin")
def histogram_right_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(journeys.right_closed(F.col("value"), _EDGES).alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem)
 SELECT max(CASE WHEN i = floor(n * 0.5) THEN x END) AS p50, max(CASE WHEN i = floor(n * 0.95) THEN x END) AS p95, max(CASE WHEN i = floor(n * 0.99) THEN x END) AS p99 FROM s""")
def index_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journeys.index_percentiles(read(spark, sf_dir, "lineitem"), "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS least, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS most FROM events GROUP BY event_type")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, rows = F.col("value"), read(spark, sf_dir, "events")
    sums = rows.groupBy("event_type").agg(F.count(v).alias("n"), r6(F.avg(v), "mean"), r6(F.stddev_samp(v), "std"), F.min(v).alias("least"), F.max(v).alias("most"))
    quarters = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    found = quantiles.quantiles(rows, ["event_type"], "value", quarters).select(F.col("event_type").alias("_type"), *(r6(F.col(q), q) for q in quarters))
    return sums.join(found, F.col("event_type").eqNullSafe(F.col("_type")), "left").drop("_type")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.absent'), 'none') AS absent FROM events")
def json_extract_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.from_json("props", "k long, absent string")
    return read(spark, sf_dir, "events").select("event_id", p.alias("p")).select("event_id", "p.k", F.coalesce("p.absent", F.lit("none")).alias("absent"))


# Distances: customers are origins, suppliers stops, on made-up places around one city.
_PLACES_SQL = """o AS (SELECT c_custkey AS id, 37.4 + (c_custkey * 7919 % 1000) * 0.0002 AS lat, 126.9 + (c_custkey * 104729 % 1000) * 0.0002 AS lon FROM customer),
 s AS (SELECT s_suppkey AS id, 37.4 + (s_suppkey * 6271 % 1000) * 0.0002 AS lat, 126.9 + (s_suppkey * 15485 % 1000) * 0.0002 AS lon FROM supplier)"""
_HAV = "2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - {a}))"


def _dist(a: str, b: str) -> str:
    h = f"(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))"
    return _HAV.format(a=h)


def _places(spark: SparkSession, sf_dir: str, name: str, key: str, m1: int, m2: int) -> DataFrame:
    at = lambda m, base: F.lit(base) + (F.col(key) * m % 1000) * 0.0002
    return read(spark, sf_dir, name).select(F.col(key).alias("id"), at(m1, 37.4).alias("lat"), at(m2, 126.9).alias("lon"))


def _origins(spark, sf_dir):
    return _places(spark, sf_dir, "customer", "c_custkey", 7919, 104729)


def _stops(spark, sf_dir):
    return _places(spark, sf_dir, "supplier", "s_suppkey", 6271, 15485)


@query(f"""WITH {_PLACES_SQL}, d AS (SELECT o.id, s.id AS other, {_dist("o", "s")} AS metres FROM o, s), r AS (SELECT *,
  row_number() OVER (PARTITION BY id ORDER BY metres, other) AS rank FROM d WHERE metres <= 2000)
 SELECT id, other, rank, round(metres, 3) AS metres, CAST(ceil(metres / 1.2) AS INT) AS seconds FROM r WHERE rank <= 30""")
def haversine_knn30(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.nearest(_origins(spark, sf_dir), _stops(spark, sf_dir), 2000.0, 30)
    return found.select("id", "other", "rank", F.round("metres", 3).alias("metres"), geo.walk_seconds(F.col("metres")).alias("seconds"))


@query(f"""WITH {_PLACES_SQL}, t AS (SELECT id, lat, lon FROM s), d AS (SELECT s.id, t.id AS other, {_dist("s", "t")} AS metres FROM s, t
  WHERE s.id <> t.id) SELECT id, other, round(metres, 3) AS metres FROM d WHERE metres <= 1500""")
def transfer_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.transfers(_stops(spark, sf_dir), 1500.0, 3)


@query(f"""WITH {_PLACES_SQL}, d AS (SELECT o.id, s.id AS other, {_dist("o", "s")} AS metres FROM o, s) SELECT id, arg_min(other, (metres, other)) AS node FROM d WHERE metres <= 3000 GROUP BY id""")
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(_origins(spark, sf_dir), _stops(spark, sf_dir), 3000.0, 1).select("id", F.col("other").alias("node"))


_GRAPH_SQL = """e AS (SELECT s_suppkey AS src, s_suppkey + d AS dst, 50.0 + (s_suppkey * d * 31) % 200 AS cost FROM supplier, (VALUES (1), (3)) v(d)
  WHERE s_suppkey + d <= (SELECT max(s_suppkey) FROM supplier)),
 edges AS (SELECT src, dst, CAST(cost AS DOUBLE) AS cost FROM e UNION ALL SELECT dst, src, CAST(cost AS DOUBLE) FROM e WHERE src % 5 <> 0)"""


@query(f"""WITH RECURSIVE {_GRAPH_SQL}, p AS (SELECT n_nationkey + 1 AS source, CAST(n_nationkey + 1 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS cost
  FROM nation WHERE n_nationkey + 1 <= (SELECT max(s_suppkey) FROM supplier)
  UNION SELECT p.source, edges.dst, p.cost + edges.cost FROM p JOIN edges ON edges.src = p.node WHERE p.cost <= 500)
 SELECT CAST(source AS BIGINT) AS source, node, min(cost) AS cost FROM p GROUP BY 1, 2""")
def shortest_path_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walking costs from some nodes; nodes farther than the bound aren't expanded."""
    _checkpointed(spark)
    s = read(spark, sf_dir, "supplier")
    most = s.agg(F.max("s_suppkey").alias("most"))
    e = s.join(F.broadcast(most)).select(F.col("s_suppkey").alias("src"), "most", F.explode(F.array(F.lit(1), F.lit(3))).alias("d"))
    e = e.where("src + d <= most").select("src", (F.col("src") + F.col("d")).alias("dst"), (F.lit(50.0) + F.col("src") * F.col("d") * 31 % 200).alias("cost"))
    edges = e.union(e.where("src % 5 <> 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"))
    sources = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("source")).join(F.broadcast(most)).where("source <= most")
    return spatial.shortest_paths(edges, sources, 500.0)


def _checkpointed(spark: SparkSession) -> None:
    """The checkpoint folder of the session; one on this machine only where the session runs on this machine alone and names none."""
    import tempfile

    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
            raise RuntimeError("on a cluster spark.checkpoint.dir has to name a shared folder")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="farebox-"))


# Timetables: an order is a trip, its lines are stops; a supplier's remainder is the stop.
_EV_SQL = """ev AS (SELECT l_orderkey AS trip, l_orderkey % 50 AS route, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
  l_suppkey, l_extendedprice, l_quantity) - 1 AS pos, l_suppkey % 40 AS stop FROM lineitem),
 events_ AS (SELECT trip, route, pos, stop, (trip * 37) % 72000 + 14400 + pos * 300 AS arr, (trip * 37) % 72000 + 14430 + pos * 300 AS dep FROM ev)"""


def _timetable(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip"), (F.col("l_orderkey") % 50).alias("route"), (F.row_number().over(order) - 1).cast("long").alias("pos"), (F.col("l_suppkey") % 40).alias("stop"))
    start = F.col("trip") * 37 % 72_000 + F.col("pos") * 300
    return rows.withColumns({"arr": start + 14_400, "dep": start + 14_430})


@query(f"WITH {_EV_SQL} SELECT min(dep) AS first_dep, max(arr) AS last_arr FROM events_")
def service_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.service_window(_timetable(spark, sf_dir))


@query(f"WITH {_EV_SQL}, t AS (SELECT route, trip, string_agg(stop, ',' ORDER BY pos) AS stops FROM events_ GROUP BY 1, 2) SELECT route, stops, count(*) AS trips, min(trip) AS first_trip FROM t GROUP BY 1, 2")
def pattern_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.patterns(_timetable(spark, sf_dir))


@query(f"WITH {_EV_SQL}, r AS (SELECT DISTINCT stop, route FROM events_) SELECT stop, string_agg(route, ',' ORDER BY route) AS routes, count(*) AS n_routes FROM r GROUP BY stop")
def routes_by_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.routes_by_stop(_timetable(spark, sf_dir))


_AT_SQL = "e AS (SELECT event_type AS key, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS at, min(event_id) AS event_id FROM events GROUP BY 1, 2), q AS (SELECT o_orderkey AS query_id, ['click', 'view', 'purchase', 'login', 'logout'][1 + o_orderkey % 5] AS key, 1704067200 + (o_orderkey * 7919) % 2592000 AS at FROM orders)"
_KINDS = ["click", "view", "purchase", "login", "logout"]


def _as_of(spark: SparkSession, sf_dir: str, forward: bool) -> DataFrame:
    e = _taps(spark, sf_dir).select(F.col("event_type").alias("key"), "at", "event_id")
    key = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    q = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), key.alias("key"), (F.lit(1_704_067_200) + F.col("o_orderkey") * 7919 % 2_592_000).alias("at"))
    return tt.as_of(q, e, "key", forward).select("query_id", "event_id", "event_at")


@query(f"WITH {_AT_SQL} SELECT q.query_id, e.event_id, e.at AS event_at FROM q ASOF LEFT JOIN e ON q.key = e.key AND e.at >= q.at")
def next_departure_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_of(spark, sf_dir, True)


@query(f"WITH {_AT_SQL} SELECT q.query_id, e.event_id, e.at AS event_at FROM q ASOF LEFT JOIN e ON q.key = e.key AND e.at <= q.at")
def latest_arrival_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_of(spark, sf_dir, False)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE a.o_custkey = b.o_custkey AND b.o_totalprice <= a.o_totalprice AND b.o_orderdate <= a.o_orderdate AND (b.o_totalprice < a.o_totalprice OR b.o_orderdate < a.o_orderdate))")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.pareto_front(read(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderdate").select("o_orderkey", "o_custkey", "o_totalprice")


def _boarding(n: int) -> str:
    """SQL of one round of boardings after the (n - 1)th."""
    was, wait = ("f0" if n == 1 else f"b{n - 1}"), 0 if n == 1 else 60
    return f""", r{n} AS (SELECT f.origin, e.route, e.pos, arg_min(e.trip, (e.dep, e.trip)) AS trip FROM {was} f JOIN events_ e ON e.stop = f.stop AND e.dep >= f.arr + {wait} GROUP BY 1, 2, 3),
 d{n} AS (SELECT r.origin, e.stop, e.arr FROM r{n} r JOIN events_ e ON e.trip = r.trip AND e.pos > r.pos),
 w{n} AS (SELECT * FROM d{n} UNION ALL SELECT origin, (stop + 1) % 40, arr + 240 FROM d{n} WHERE stop % 3 = 0),
 m{n} AS (SELECT origin, stop, min(arr) AS arr FROM w{n} GROUP BY 1, 2),
 k{n} AS (SELECT origin, stop, min(arr) AS arr FROM ({" UNION ALL ".join(f"SELECT origin, stop, arr FROM {x}" for x in ["f0", *(f"b{i}" for i in range(1, n))])}) GROUP BY 1, 2),
 b{n} AS (SELECT m.origin, m.stop, {n} AS boardings, m.arr FROM m{n} m LEFT JOIN k{n} k USING (origin, stop) WHERE k.arr IS NULL OR m.arr < k.arr)"""


@query(f"""WITH {_EV_SQL}, f0 AS (SELECT CAST(n_nationkey % 40 AS BIGINT) AS origin, CAST(n_nationkey % 40 AS BIGINT) AS stop, 0 AS boardings,
  CAST(28800 AS BIGINT) AS arr FROM nation) {_boarding(1)} {_boarding(2)} {_boarding(3)}
 SELECT * FROM f0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3""")
def raptor_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earliest arrivals with up to three boardings."""
    _checkpointed(spark)
    origins = read(spark, sf_dir, "nation").select((F.col("n_nationkey") % 40).cast("long").alias("origin"), F.lit(28_800).cast("long").alias("at"))
    paths = spark.range(40).where("id % 3 = 0").select(F.col("id").alias("src"), ((F.col("id") + 1) % 40).alias("dst"), F.lit(240).alias("seconds"))
    return tt.earliest_arrivals(_timetable(spark, sf_dir), paths, origins, 3)


_TRIPS_SQL = "t AS (SELECT o_custkey % 20 AS route, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - 1 AS turn, 18000 + o_orderkey AS dep FROM orders)"


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("route").orderBy("o_orderkey")) - 1
    return read(spark, sf_dir, "orders").withColumn("route", F.col("o_custkey") % 20).select("route", turn.alias("turn"), (F.lit(18_000) + F.col("o_orderkey")).alias("dep"))


@query(f"WITH {_TRIPS_SQL}, n AS (SELECT route, count(*) AS n FROM t GROUP BY route), p AS (SELECT route, least(CAST(floor(i * 2.5 + 0.5) AS BIGINT), n - 1) AS turn FROM n, LATERAL (SELECT unnest(range(0, greatest(1, CAST(ceil(n / 2.5) AS BIGINT)))) AS i)) SELECT DISTINCT t.route, t.turn, t.dep FROM t JOIN p USING (route, turn)")
def headway_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.thinned(_trips(spark, sf_dir), 2.5).select("route", F.col("turn").cast("long").alias("turn"), "dep")


@query(f"WITH {_TRIPS_SQL}, s AS (SELECT route, count(*) AS n, min(dep) AS a, max(dep) AS b FROM t GROUP BY route), m AS (SELECT route, a, b, CAST(ceil(n / 0.4) AS BIGINT) AS m FROM s WHERE n > 1) SELECT route, i AS turn, a + i * ((b - a) // greatest(m - 1, 1)) AS dep FROM m, LATERAL (SELECT unnest(range(0, m)) AS i) UNION ALL SELECT route, 0, a FROM s WHERE n = 1")
def headway_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.interpolated(_trips(spark, sf_dir), 0.4).select("route", F.col("turn").cast("long").alias("turn"), "dep")


@query("""WITH r AS (SELECT 100 + n_nationkey AS route, 18000 + n_nationkey * 60 AS first, 18000 + n_nationkey * 500 AS last, 600 + n_nationkey % 5 * 300 AS headway, n_nationkey FROM nation),
 s AS (SELECT route, row_number() OVER w - 1 AS pos, s_suppkey AS stop, CASE WHEN s_suppkey % 4 = 0 THEN 300 ELSE 60 + s_suppkey * 7 % 500 END AS leg
   FROM supplier JOIN r ON n_nationkey = s_nationkey WINDOW w AS (PARTITION BY route ORDER BY s_suppkey)),
 c AS (SELECT *, sum(CASE WHEN pos = 0 THEN 0 ELSE leg END) OVER (PARTITION BY route ORDER BY pos) + pos * 30 AS at_ FROM s),
 t AS (SELECT route, unnest(range(first, last + 1, headway)) AS start, first, headway FROM r)
 SELECT route, (start - first) // headway AS turn, pos, stop, CAST(start + at_ AS BIGINT) AS arr, CAST(start + at_ + 30 AS BIGINT) AS dep FROM t JOIN c USING (route)""")
def add_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A route for each nation along its suppliers; legs whose time isn't given take five minutes."""
    n, key = F.col("n_nationkey"), F.col("s_suppkey")
    routes = read(spark, sf_dir, "nation").select((100 + n).alias("route"), (18_000 + n * 60).alias("first"), (18_000 + n * 500).alias("last"), (600 + n % 5 * 300).alias("headway"))
    order = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    stops = read(spark, sf_dir, "supplier").select((100 + F.col("s_nationkey")).alias("route"), (F.row_number().over(order) - 1).alias("pos"), key.alias("stop"), F.when(key % 4 != 0, 60 + key * 7 % 500).alias("leg"))
    made = tt.added_routes(routes, stops)
    return made.select(*(F.col(c).cast("long").alias(c) for c in ("route", "turn", "pos", "stop", "arr", "dep")))


@query(f"WITH {_TRIPS_SQL} SELECT route, turn, dep FROM t WHERE route NOT IN (3, 4, 5) UNION ALL SELECT route, turn, dep + 60 FROM t WHERE route = 5 UNION ALL SELECT 77, 0, 20000")
def scenario_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes 3 and 4 are disabled, 4 and 5 changed, 77 is added: disabled beats changed."""
    base = _trips(spark, sf_dir).withColumn("turn", F.col("turn").cast("long"))
    disabled = spark.range(3, 5).select(F.col("id").alias("route"))
    changed = base.where("route in (4, 5)").withColumn("dep", F.col("dep") + 60)
    added = spark.range(1).select(F.lit(77).cast("long").alias("route"), F.lit(0).cast("long").alias("turn"), F.lit(20_000).cast("long").alias("dep"))
    return tt.overlay(base, disabled, changed, added)


@query(f"""WITH {_TRIPS_SQL}, b AS (SELECT route, count(*) AS n, min(dep) AS first FROM t GROUP BY 1), s AS (SELECT route, count(*) AS n,
  min(dep) + 60 AS first FROM t WHERE route NOT IN (3, 4) AND turn % 2 = 0 GROUP BY 1)
 SELECT coalesce(b.route, s.route) AS route, coalesce(s.n, 0) - coalesce(b.n, 0) AS trips, s.first - b.first AS seconds FROM b LEFT JOIN s ON b.route = s.route""")
def scenario_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _trips(spark, sf_dir)
    s = base.where("route not in (3, 4) and turn % 2 = 0").groupBy("route").agg(F.count("*").alias("sn"), (F.min("dep") + 60).alias("sf"))
    b = base.groupBy("route").agg(F.count("*").alias("bn"), F.min("dep").alias("bf"))
    return b.join(s, "route", "left").select("route", (F.coalesce("sn", F.lit(0)) - F.col("bn")).alias("trips"), (F.col("sf") - F.col("bf")).alias("seconds"))


@query("""SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1100 END AS route_type,
 CASE p_size % 8 WHEN 1 THEN 'SUBWAY' WHEN 2 THEN 'FERRY' WHEN 4 THEN 'RAIL' WHEN 6 THEN 'RAIL' ELSE 'BUS' END AS mode,
 split_part('1:BS_' || p_size || '_' || p_partkey, '_', 3) AS code, '1:' || p_partkey AS feed_id, to_base64(encode('Stop:1:' || p_partkey)) AS global_id,
 CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_name END AS shown, printf('%02d:%02d:%02d', (p_partkey * 97 % 100000) // 3600,
  (p_partkey * 97 % 100000) % 3600 // 60, (p_partkey * 97 % 100000) % 60) AS clock,
 CAST(p_partkey * 97 % 100000 AS INT) AS parsed, CAST((p_partkey * 97 % 100000 + 30) // 60 AS INT) AS minutes FROM part""")
def names_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").withColumn("rt", text.standard_route_type(F.col("p_size") % 8)).withColumn("s", (F.col("p_partkey") * 97 % 100_000).cast("int"))
    key = F.col("p_partkey").cast("string")
    clock = times.hhmmss(F.col("s"))
    return p.select(
        "p_partkey", F.col("rt").alias("route_type"), text.mode(F.col("rt")).alias("mode"), text.code(F.concat(F.lit("1:BS_"), F.col("p_size"), F.lit("_"), key)).alias("code"), text.feed_id(key).alias("feed_id"), text.global_id(key).alias("global_id"),
        text.display_name(F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise("-"), F.col("p_name"), key).alias("shown"), clock.alias("clock"), times.parse_time(clock).alias("parsed"), times.to_minutes(F.col("s")).alias("minutes"),
    )


@query("SELECT p_partkey, p_name, CAST(CASE WHEN lower(p_name) = 'part 1' THEN 1 WHEN lower(p_name) LIKE 'part%' THEN 2 ELSE 3 END AS INT) AS tier FROM part WHERE lower(p_name) LIKE '%a%' ORDER BY CASE WHEN lower(p_name) = 'a' THEN 1 WHEN lower(p_name) LIKE 'a%' THEN 2 ELSE 3 END, p_name, p_partkey LIMIT 25".replace("'part 1'", "'a'").replace("'part%'", "'a%'"))
def route_search_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").withColumn("tier", text.search_tier(F.col("p_name"), "a")).where("tier is not null")
    return rows.orderBy("tier", "p_name", "p_partkey").limit(25).select("p_partkey", "p_name", "tier")
