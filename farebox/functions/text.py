"""Identifiers, names and modes of routes and stops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: National route types to the standard's.
ROUTE_TYPES = {0: 3, 1: 1, 2: 4, 3: 3, 4: 2, 5: 3, 6: 2, 7: 1100}
#: The mode of a route type; any other is a bus.
MODES = {1: "SUBWAY", 12: "SUBWAY", 2: "RAIL", 100: "RAIL", 101: "RAIL", 102: "RAIL", 4: "FERRY", 7: "FUNICULAR"}


def bare(identifier: Column) -> Column:
    """An identifier without the feed before its colon."""
    return F.regexp_replace(identifier, "^[^:]*:", "")


def code(identifier: Column) -> Column:
    """The part that matters of ``feed:KIND_REGION_CODE``: what follows the second underscore, or all behind the feed."""
    bare = F.regexp_replace(identifier, "^[^:]*:", "")
    parts = F.split(bare, "_")
    return F.when(F.length(identifier) > 0, F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(3))).otherwise(bare))


def feed_id(identifier: Column, feed: str = "1") -> Column:
    return F.concat(F.lit(f"{feed}:"), F.coalesce(identifier, F.lit("unknown")))


def global_id(identifier: Column, feed: str = "1") -> Column:
    return F.base64(F.encode(F.concat(F.lit(f"Stop:{feed}:"), identifier), "UTF-8"))


def display_name(short: Column, long: Column, identifier: Column) -> Column:
    """The short name, else the long one, else the identifier; empty names and dashes don't count."""
    named = lambda c: F.when(~F.trim(c).isin("", "-"), F.trim(c))
    return F.coalesce(named(short), named(long), identifier)


def _lookup(value: Column, of: dict, default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), value.cast("int")), default)


def standard_route_type(national: Column) -> Column:
    return _lookup(national, ROUTE_TYPES, F.lit(None).cast("int"))


def mode(route_type: Column) -> Column:
    return _lookup(route_type, MODES, F.lit("BUS"))


def is_kind(route_type: Column, kind: str) -> Column:
    """Whether a route type belongs to subway, bus, rail or tram, extended types included."""
    ranges = {"subway": (1, 400, 499), "bus": (3, 700, 799), "rail": (2, 100, 199), "tram": (0, 900, 999)}
    one, low, high = ranges[kind]
    return (route_type == one) | route_type.between(low, high) if kind != "tram" else route_type == one


def search_tier(name: Column, keyword: str) -> Column:
    """1 for an exact match, 2 for a beginning, 3 for any other occurrence, else null; case doesn't count."""
    low, key = F.lower(name), keyword.lower()
    return F.when(low == key, 1).when(low.startswith(key), 2).when(low.contains(key), 3)


#: Prefixes of a search for routes and the kind that each asks for.
SEARCH_EXACT, SEARCH_KINDS = "ROUTE:", {"버스_": "bus", "지하철_": "subway"}


def search_hit(route_id: Column, name: Column, route_type: Column, pattern: str) -> Column:
    """Whether a route is meant: by its exact identifier, by its kind and a part of its name, or by a part of its name; an empty pattern means none."""
    pattern = pattern.strip()
    if not pattern:
        return F.lit(False)
    if pattern.startswith(SEARCH_EXACT):
        return F.coalesce(route_id == pattern.removeprefix(SEARCH_EXACT), F.lit(False))
    for prefix, kind in SEARCH_KINDS.items():
        if pattern.startswith(prefix):
            part = pattern.removeprefix(prefix).lower()
            return F.coalesce(is_kind(route_type, kind) & F.lower(name).contains(part), F.lit(False))
    return F.coalesce(F.lower(name).contains(pattern.lower()), F.lit(False))
