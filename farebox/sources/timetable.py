"""Readers of timetable text files, requests and routing results. Every schema is declared; malformed rows are left out, never fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.functions.times import parse_time
from farebox.operators.ordinals import numbered

#: The columns of each file by place, and the fewest fields of a row.
FILES = {
    "stops": ("stop_id string, stop_name string, stop_lat double, stop_lon double", 4),
    "routes": ("route_id string, agency_id string, route_short_name string, route_long_name string, route_type int", 5),
    "trips": ("route_id string, service_id string, trip_id string", 3),
    "stop_times": ("trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence double, pickup_type int, drop_off_type int", 7),
}
KEYS = {"stops": "stop_id", "routes": "route_id", "trips": "trip_id"}


def check_columns(spark: SparkSession, path: str, name: str) -> None:
    """Raises unless the first line of a file names all the columns that are read from it."""
    first = spark.read.text(path).select(F.regexp_replace("value", "^\\uFEFF", "").alias("value")).first()
    named = {c.strip().strip('"') for c in first[0].split(",")} if first else set()
    missing = [c.rsplit(" ", 1)[0] for c in FILES[name][0].split(", ") if c.rsplit(" ", 1)[0] not in named]
    if missing:
        raise ValueError(f"{name} lacks the columns {', '.join(missing)}")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A file of a timetable: fields are split at commas (quotes mean nothing), trimmed and cast; of rows with one key the last counts."""
    ddl, least = FILES[name]
    columns = [c.rsplit(" ", 1) for c in ddl.split(", ")]
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\\uFEFF", "").alias("value"), F.monotonically_increasing_id().alias("_at"))
    parts = lines.where("trim(value) <> ''").select("_at", F.split("value", ",", -1).alias("p")).where(F.size("p") >= least)
    parts = parts.where(F.trim(F.col("p")[0]) != columns[0][0])
    rows = parts.select("_at", *(F.trim(F.try_element_at("p", F.lit(i + 1))).try_cast(kind).alias(c) for i, (c, kind) in enumerate(columns)))
    numbers = [c for c, kind in columns if kind in ("double", "int") and not c.endswith("_type")] + ["route_type"] * (name == "routes")
    rows = rows.dropna(subset=numbers) if numbers else rows
    if name == "stop_times":
        return rows.select("trip_id", parse_time(F.col("arrival_time")).alias("arr"), parse_time(F.col("departure_time")).alias("dep"), "stop_id", F.col("stop_sequence").cast("int"), "pickup_type", "drop_off_type").dropna(subset=["arr", "dep"])
    key = KEYS[name]
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c, _ in columns if c != key)), "_at").alias("r")).select(key, "r.*").select(*(c for c, _ in columns))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Origin-destination requests (from_lat, from_lon, to_lat, to_lon, HH:MM), numbered from 0 in the order of the file.

    Only the first line is a header; lines of fewer than five fields are left out, a field that should be a number and isn't is an error. Lines are
    numbered by ranges of their place (file, block, line), so no task sees them all.
    """
    places = ["_file", "_block", "_at"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    first = lines.select(F.struct(*places).alias("place")).agg(F.min("place").alias("first"))
    parts = lines.join(F.broadcast(first), F.struct(*places) != F.col("first")).select(*places, F.split("value", ",", -1).alias("p")).where(F.size("p") >= 5)  # one row

    def number(i: int):
        field = F.trim(F.col("p")[i])
        return F.coalesce(field.try_cast("double"), F.raise_error(F.concat(F.lit("not a number: "), field)).cast("double"))

    rows = numbered(parts, *places, name="id")
    return rows.select(F.col("id").cast("int").alias("id"), number(0).alias("from_lat"), number(1).alias("from_lon"), number(2).alias("to_lat"), number(3).alias("to_lon"), parse_time(F.col("p")[4]).alias("at"))


_LEG = "struct<mode:string,startTime:bigint,endTime:bigint,duration:int,distance:double,route:string>"
RESULT = f"struct<id:int,searchTimeMs:bigint,data:struct<plan:struct<itineraries:array<struct<startTime:bigint,endTime:bigint,duration:int,walkDistance:double,generalizedCost:int,legs:array<{_LEG}>>>>>>"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Routing results, one JSON text a line: a row for each itinerary (od_id, alt_id, ...), and one with alt_id null for a request without any.

    Geometries are blanked before parsing; lines that aren't JSON are left out.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", '"points"\\s*:\\s*"(?:[^"\\\\]|\\\\.)*"', '"points":""').alias("value"))
    parsed = lines.select(F.from_json("value", RESULT).alias("r")).where("r.id is not null")
    each = parsed.select(F.col("r.id").alias("od_id"), F.posexplode_outer("r.data.plan.itineraries").alias("alt_id", "i"))
    legs = F.coalesce("i.legs", F.array().cast(f"array<{_LEG}>"))
    transit = F.filter(legs, lambda leg: leg.mode.isin("BUS", "SUBWAY", "RAIL", "TRAM", "FERRY"))
    seconds = lambda kept: F.aggregate(kept, F.lit(0), lambda a, leg: a + F.coalesce(leg.duration, F.lit(0)))
    walk = F.filter(legs, lambda leg: leg.mode == "WALK")
    out = each.select("od_id", "alt_id", F.col("i.duration").alias("total_duration"), F.col("i.generalizedCost").alias("generalized_cost"), F.col("i.walkDistance").alias("walk_distance"), seconds(transit).alias("ride_time_sec"), seconds(walk).alias("walk_time_sec"), F.greatest(F.size(transit) - 1, F.lit(0)).alias("n_transfers"), F.transform(transit, lambda leg: leg.mode).alias("modes"), F.transform(transit, lambda leg: leg.route).alias("route_ids"))
    return out.withColumn("wait_time_sec", F.greatest(F.col("total_duration") - F.col("ride_time_sec") - F.col("walk_time_sec"), F.lit(0)))


def write_requests(df: DataFrame, path: str) -> None:
    """Requests as CSV with times as HH:MM."""
    from farebox.functions.times import hhmm

    df.select("from_lat", "from_lon", "to_lat", "to_lon", hhmm(F.col("at")).alias("departure_time")).write.option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(config, result) of lines ``config,result``: split at the first comma; blank lines, comments (#) and lines without a comma go."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#') and contains(v, ',')")
    parts = F.split("v", ",", 2)
    return lines.select(F.trim(parts[0]).alias("config"), F.trim(parts[1]).alias("result"))


def read_line_mapping(spark: SparkSession, path: str, routes: DataFrame) -> DataFrame:
    """(line, route) of a JSON dictionary of lines with the name each has in a timetable, and the first subway or rail route of that name.

    routes: route_id, route_short_name, route_type, and place where the order is not that of the identifiers (a number for each row).
    """
    text = spark.read.text(path, wholetext=True)
    named = text.select(F.explode(F.from_json("value", "map<string,struct<gtfs_name:string>>")).alias("line", "x")).select("line", F.col("x.gtfs_name").alias("route_short_name"))
    first = routes.where(F.col("route_type").isin(1, 2)).groupBy("route_short_name").agg(F.min_by("route_id", "place" if "place" in routes.columns else "route_id").alias("route"))
    return named.join(first, "route_short_name").select("line", "route")


def trips_with_routes(stop_times: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Stop events with the route of their trip; events of unknown trips or routes go."""
    return stop_times.join(trips.select("trip_id", "route_id"), "trip_id").join(routes.select("route_id", "route_short_name", "route_type"), "route_id")


def closed_strings(line):
    """A line in which a backslash stands before the quote that ends a string (before }, ] or a comma), with the backslash escaped."""
    return F.regexp_replace(line, '\\\\("[}\\],])', '\\\\\\\\$1')


def _manifest(path: str) -> str:
    return path.rstrip("/") + ".chunks"


def write_results(results: DataFrame, path: str, chunk: str = "chunk", chunks: DataFrame | None = None) -> None:
    """One JSON text a line, in a folder for each chunk; a run that goes on replaces only the chunks that it has. Then the chunks are committed.

    chunks: the chunks of this run, those without results too (None: those of the results, which are then computed twice). They are appended to a
    manifest beside the results after all files are there. A run that ends in between leaves its chunks uncommitted, and the next one does them
    again.
    """
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(chunk).json(path)
    done = results if chunks is None else chunks
    done.select(F.col(chunk).cast("long").alias("chunk")).distinct().coalesce(1).write.mode("append").json(_manifest(path))


def finished_chunks(spark: SparkSession, path: str, chunk: str = "chunk") -> DataFrame:
    """The committed chunks, from the manifest alone; empty where nothing has been committed."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("chunk long").json(_manifest(path)).select(F.col("chunk").alias(chunk)).distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], f"{chunk} long")
        raise


def resolved(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """df with columns under the names that are expected: each the first of its aliases that df has; raises where it has none."""
    out = df
    for name, options in aliases.items():
        have = next((c for c in [name, *options] if c in df.columns), None)
        if have is None:
            raise ValueError(f"no column for {name} among {', '.join(options)}")
        if have != name:
            out = out.withColumnRenamed(have, name)
    return out
