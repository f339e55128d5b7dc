"""Similarities of sequences and slices of routes, as expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The longest second sequence whose positions are bits of one number.
BITS = 61


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence.

    Up to BITS elements of b are the bits of a number: each element of a has a mask of its places in b, and a sum carries the row of the
    table on, so a pair of sequences costs as many steps as it has cells. Longer ones fold over a with the row as an array.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    shifted = lambda n: F.call_function("shiftleft", one, n)
    full = shifted(F.least(F.size(b), F.lit(BITS))) - 1
    places = lambda x: F.aggregate(F.transform(b, lambda y, i: F.when(y == x, shifted(i)).otherwise(none)), none, lambda s, v: s.bitwiseOR(v))
    row = F.aggregate(F.transform(a, places), full, lambda v, m: (v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full))
    short = F.size(b) - F.bit_count(row)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).when(F.size(b) <= BITS, short).otherwise(_folded_lcs(a, b)).cast("int")


def _folded_lcs(a: Column, b: Column) -> Column:
    zeros = F.transform(b, lambda _: F.lit(0))

    def row(above: Column, x: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("row"), F.lit(0).alias("left"), F.lit(0).alias("corner"))

        def step(s: Column, pair: Column) -> Column:
            here = F.when(pair.y == x, s.corner + 1).otherwise(F.greatest(s.left, pair.up))
            return F.struct(F.array_append(s.row, here).alias("row"), here.alias("left"), pair.up.alias("corner"))

        pairs = F.zip_with(b, above, lambda y, up: F.struct(y.alias("y"), up.alias("up")))
        return F.aggregate(pairs, start, step, lambda s: s.row)

    return F.try_element_at(F.aggregate(a, zeros, row), F.lit(-1))


def _edge(a: Column, b: Column, otherwise: Column) -> Column:
    empty_a, empty_b = F.size(a) == 0, F.size(b) == 0
    return F.when(empty_a & empty_b, 1.0).when(empty_a | empty_b, 0.0).otherwise(otherwise)


def lcs_similarity(a: Column, b: Column) -> Column:
    return _edge(a, b, 2.0 * lcs_length(a, b) / (F.size(a) + F.size(b)))


def lcs_ratio(a: Column, b: Column) -> Column:
    return _edge(a, b, lcs_length(a, b).cast("double") / F.greatest(F.size(a), F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    return _edge(a, b, F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b)))


def pair_match_rate(board_a: Column, alight_a: Column, board_b: Column, alight_b: Column) -> Column:
    """The share of equal boardings and alightings, position by position, over twice the longer journey."""
    hits = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return (hits(board_a, board_b) + hits(alight_a, alight_b)).cast("double") / (2 * F.greatest(F.size(board_a), F.size(board_b), F.lit(1)))


def time_similarity(a: Column, b: Column) -> Column:
    return F.when((a <= 0) | (b <= 0), 0.0).otherwise(1.0 - F.least(F.lit(1.0), F.abs(a - b) / F.greatest(a, b)))


def time_difference(a: Column, b: Column) -> Column:
    """The difference of two durations; -1 where either isn't positive or is unknown."""
    return F.when((a > 0) & (b > 0), F.abs(a - b)).otherwise(-1)


def translated(a: Column, mapping: Column) -> Column:
    """The elements that a map knows, translated, in their order."""
    return F.filter(F.transform(a, lambda x: F.try_element_at(mapping, x)), lambda x: x.isNotNull())


def bus_only(modes: Column) -> Column:
    return ((F.size(modes) > 0) & F.forall(modes, lambda m: m == "BUS")).cast("int")


def traversed(route: Column, board: Column, alight: Column) -> Column:
    """(status, stops) of a ride along a circular route: from board to alight, past the end if alight comes first."""
    at, to, n = F.array_position(route, board), F.array_position(route, alight), F.size(route)
    at, to = at.cast("int"), to.cast("int")
    wrapped = F.concat(F.slice(route, F.greatest(at, F.lit(1)), n), F.slice(route, F.lit(1), F.greatest(to, F.lit(0))))
    plain = F.slice(route, F.greatest(at, F.lit(1)), F.greatest(to - at + 1, F.lit(0)))
    none = F.slice(route, 1, 0)
    status = F.when(route.isNull(), "no_route").when(at == 0, "board_not_found").when(to == 0, "alight_not_found").otherwise("ok")
    return F.struct(status.alias("status"), F.when(status != "ok", none).when(at <= to, plain).otherwise(wrapped).alias("stops"))


def ridden(stops: Column, board: Column, alight: Column) -> Column:
    """The stops of a pattern from the first boarding to the first alighting after it, both included; empty without such a ride."""
    at = F.array_position(stops, board).cast("int")
    rest = F.slice(stops, at + 1, F.size(stops))
    to = F.when(at > 0, F.array_position(rest, alight)).otherwise(0).cast("int")
    return F.when(to > 0, F.slice(stops, F.greatest(at, F.lit(1)), to + 1)).otherwise(F.slice(stops, 1, 0))


def between_stops(ride: Column) -> Column:
    """What lies between the ends of a ride."""
    return F.slice(ride, 2, F.greatest(F.size(ride) - 2, F.lit(0)))


def rail_as_subway(modes: Column) -> Column:
    return F.transform(modes, lambda m: F.when(m == "RAIL", "SUBWAY").otherwise(m))


def boardable(pos: Column, stops: Column, pickup: Column) -> Column:
    """Nobody boards at the last position, nor where the pickup type isn't 0."""
    return (pos < F.size(stops) - 1) & (F.coalesce(pickup, F.lit(0)) == 0)


def alightable(pos: Column, drop_off: Column) -> Column:
    return (pos > 0) & (F.coalesce(drop_off, F.lit(0)) == 0)
