"""Distances, walking times and grid cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres, metres per second, degrees.
EARTH_RADIUS = 6_371_000.0
WALK_SPEED = 1.2
CELL = 0.001
LAT_METRES = 111_000.0
LON_METRES = 88_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def flat_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres on a plane, for short distances at middle latitudes."""
    return F.sqrt(F.pow((lat2 - lat1) * LAT_METRES, 2) + F.pow((lon2 - lon1) * LON_METRES, 2))


def walk_seconds(metres: Column) -> Column:
    return F.ceil(metres / WALK_SPEED).cast("int")


def walk_minutes(metres: Column) -> Column:
    return F.ceil(metres / (WALK_SPEED * 60)).cast("int")


def cell(degrees: Column, size: float = CELL) -> Column:
    return F.floor(degrees / size).cast("long")


def in_korea(lat: Column, lon: Column) -> Column:
    """A rough box around the country."""
    return lat.between(33.0, 39.0) & lon.between(124.0, 132.0)


def distance_text(metres: Column) -> Column:
    return F.when(metres < 1000, F.format_string("%.0fm", metres)).otherwise(F.format_string("%.1fkm", metres / 1000))


def slack_index(route_type: Column) -> Column:
    """0 subway, 1 bus, 2 rail, 3 air."""
    between = lambda a, b: (route_type >= a) & (route_type < b)
    return (
        F.when(route_type.isin(0, 1, 2, 5, 6) | between(400, 500) | between(900, 1000), 0)
        .when(route_type.isin(4, 7) | between(100, 300), 2).when(between(1100, 1200), 3).otherwise(1)
    )


#: Names of the route types.
TYPE_NAMES = {0: "트램", 1: "지하철", 2: "철도", 3: "버스", 4: "페리", 5: "케이블카", 6: "케이블카", 7: "푸니쿨라"}
RANGE_NAMES = {(100, 200): "철도", (400, 500): "도시철도", (700, 800): "버스", (1100, 1200): "항공"}
OTHER_NAME = "기타"


def route_type_name(route_type: Column) -> Column:
    out = F.lit(OTHER_NAME)
    for (a, b), name in RANGE_NAMES.items():
        out = F.when((route_type >= a) & (route_type < b), name).otherwise(out)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TYPE_NAMES.items() for x in kv)), route_type.cast("int")), out)


def _polyline_value(value: Column) -> Column:
    """A signed number as characters of five bits each, the lowest first."""
    v = F.shiftleft(value.cast("int"), 1)
    v = F.when(value < 0, F.bitwise_not(v)).otherwise(v)
    n = sum(((v >= (1 << 5 * k)).cast("int") for k in range(1, 6)), F.lit(1))
    digit = lambda k: F.shiftright(v, 5 * k).bitwiseAND(31) + F.when(F.lit(k + 1) < n, 32).otherwise(0) + 63
    return F.concat(*(F.when(F.lit(k) < n, F.char(digit(k))).otherwise("") for k in range(6)))


def polyline(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Two points as an encoded polyline of five decimals."""
    e5 = lambda x: F.floor(x * 1e5 + 0.5).cast("int")
    return F.concat(_polyline_value(e5(lat1)), _polyline_value(e5(lon1)), _polyline_value(e5(lat2) - e5(lat1)), _polyline_value(e5(lon2) - e5(lon1)))


def to_seconds(minutes: Column) -> Column:
    """Minutes as text to whole seconds; null for what is no number."""
    return (minutes.try_cast("double") * 60).cast("int")


#: How far walks between stops, and walks to and from stops, may be in metres.
WALKABLE, ACCESSIBLE = 500.0, 800.0


def walkable(metres: Column) -> Column:
    """Whether a transfer may be walked; an unknown distance may not."""
    return F.coalesce(metres <= WALKABLE, F.lit(False))


def accessible(metres: Column) -> Column:
    """Whether a stop may be walked to; an unknown distance may not."""
    return F.coalesce(metres <= ACCESSIBLE, F.lit(False))
