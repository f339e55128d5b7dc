"""Similarities of sequences that forgive: stops near one another, modes that stand for one another. Expressions on array columns.

Both are dynamic programmes with real-valued cells, done by Arrow batches: pairs of sequences of equal lengths go through their tables together, a
row of all tables at a time. So a pair costs as many steps as its table has cells, and holds two rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from farebox.functions.geo import EARTH_RADIUS

#: How far apart matching stops may be in metres, and what it costs to take one mode for another; anything else costs 1.
TOLERANCE = 300.0
MODE_COSTS = {("BUS", "SUBWAY"): 0.7, ("BUS", "RAIL"): 0.8, ("SUBWAY", "RAIL"): 0.3}

#: Pairs of sequences of equal lengths: two arrays of numbers of pairs by places of values.
Places = tuple[np.ndarray, np.ndarray]


def _of_equal_lengths(a: pa.ListArray, b: pa.ListArray) -> Iterator[tuple[np.ndarray, Places]]:
    """The numbers of pairs of which both lengths are the same and above 0, and where their values lie among those of all a or b."""
    m, n = (x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    starts = [np.cumsum(x) - x for x in (m, n)]
    some = np.flatnonzero((m > 0) & (n > 0))
    some = some[np.lexsort((n[some], m[some]))]
    cuts = np.flatnonzero((np.diff(m[some]) != 0) | (np.diff(n[some]) != 0)) + 1
    for rows in np.split(some, cuts):
        if rows.size:
            yield rows, (starts[0][rows][:, None] + np.arange(m[rows[0]]), starts[1][rows][:, None] + np.arange(n[rows[0]]))


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
    """The values of both as numbers of one list of distinct values, nulls as -1."""
    found = pa.concat_arrays([a, b]).dictionary_encode()
    at = found.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return at[: len(a)], at[len(a) :], found.dictionary.to_pylist()


def _result(a: pa.ListArray, b: pa.ListArray, value: np.ndarray) -> pa.Array:
    """value, but 1 for two empty sequences, 0 for one, null where a sequence is null."""
    m, n = (x.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) for x in (a, b))
    out = np.where((m == 0) & (n == 0), 1.0, np.where((m == 0) | (n == 0), 0.0, value))
    return pa.array(out, pa.float64(), mask=(m < 0) | (n < 0))


def _near(tolerance: float) -> Callable[[pa.Array, pa.Array], pa.Array]:
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        (id_a, *of_a), (id_b, *of_b) = (x.flatten().flatten() for x in (a, b))
        id_a, id_b, _ = _codes(id_a, id_b)
        (lat_a, lon_a), (lat_b, lon_b) = ([np.radians(c.cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in x] for x in (of_a, of_b))
        value = np.zeros(len(a))
        with np.errstate(invalid="ignore"):
            for rows, (i, j) in _of_equal_lengths(a, b):
                ids, lat, lon = id_b[j], lat_b[j], lon_b[j]
                cos, row = np.cos(lat), np.zeros((len(rows), j.shape[1] + 1))
                for x in i.T[:, :, None]:
                    h = np.sin((lat - lat_a[x]) / 2) ** 2 + np.cos(lat_a[x]) * cos * np.sin((lon - lon_a[x]) / 2) ** 2
                    metres = 2 * EARTH_RADIUS * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
                    score = np.where(metres <= tolerance, 1.0 - metres / tolerance, 0.0)
                    score[(ids == id_a[x]) & (ids >= 0)] = 1.0
                    row[:, 1:] = np.maximum(row[:, 1:], row[:, :-1] + score)
                    row = np.maximum.accumulate(row, axis=1)
                value[rows] = 2.0 * row[:, -1] / (i.shape[1] + j.shape[1])
        return _result(a, b, value)

    return run


def tolerant_similarity(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Twice the largest sum of match scores of a common subsequence of two arrays of stops (id, lat, lon), over both lengths: 1 for two empty
    sequences, 0 for one, null where a sequence is null. Two stops score 1 if they are one, less with the distance, 0 from the tolerance on and
    for unknown places."""
    return F.arrow_udf(_near(tolerance), "double")(a, b)


def _mode_costs(modes: list) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each distinct mode (the last: of null), and what it costs to take one kind for another."""
    both = MODE_COSTS | {(y, x): cost for (x, y), cost in MODE_COSTS.items()}
    known = [*sorted({x for x, _ in both}), None]
    kinds = np.array([known.index(x) if x in known[:-1] else len(known) - 1 for x in modes] + [len(known) - 1])
    table = np.array([[both.get((x, y), 1.0) for y in known] for x in known])
    return kinds, table


def _modes(a: pa.Array, b: pa.Array) -> pa.Array:
    mode_a, mode_b, modes = _codes(a.flatten(), b.flatten())
    kinds, table = _mode_costs(modes)
    value = np.zeros(len(a))
    for rows, (i, j) in _of_equal_lengths(a, b):
        y, place = mode_b[j], np.arange(j.shape[1] + 1.0)
        row = np.tile(place, (len(rows), 1))
        for x in mode_a[i].T[:, :, None]:
            cost = np.where(x == y, 0.0, table[kinds[x], kinds[y]])
            up = np.minimum(row[:, 1:] + 1.0, row[:, :-1] + cost)
            row = np.minimum.accumulate(np.hstack([row[:, :1] + 1.0, up]) - place, axis=1) + place
        value[rows] = 1.0 - row[:, -1] / max(i.shape[1], j.shape[1])
    return _result(a, b, value)


def mode_similarity(a: Column, b: Column) -> Column:
    """1 less the weighted edit distance of two arrays of modes over the longer length; 1 for two empty sequences, null where a sequence is null.
    To leave one out costs 1, to take one for another MODE_COSTS or 1; two unknown (null) ones are alike."""
    return F.arrow_udf(_modes, "double")(a, b)
