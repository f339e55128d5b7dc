"""Observed journeys against routed alternatives: translation of identifiers, pairs within an origin and destination, weighted similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.functions import arrays

#: The share of each measure in the total similarity.
WEIGHTS = {"route_seq": 0.25, "mode_seq": 0.10, "jaccard": 0.20, "lcs": 0.25, "boarding_alighting": 0.10, "time": 0.10}
def last_entries(pairs: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """(key, value) of a mapping: of rows with one key the last in the order counts (without an order, the largest value); null keys go, and so do keys that end up
    with a null value."""
    last = F.max_by(value, order) if order else F.max(value)
    return pairs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(last.alias("_value")).where("_value is not null")


def with_translated(df: DataFrame, pairs: DataFrame, key: str, value: str, *columns: str, by: str, order: str | None = None) -> DataFrame:
    """df with the identifiers in some array columns translated, in their order; those without a translation go, and null arrays stay null.

    by: a column of df that tells its rows apart. Every element of all the columns becomes a row, which meets the dictionary by an ordinary join
    on the identifier (frequent identifiers are split by adaptive execution; a small dictionary is sent to the tasks), and one shuffle by `by` puts
    the arrays together again. Work grows with elements and dictionary, and no task holds the dictionary. df is read twice.
    """
    entries = last_entries(pairs, key, value, order)
    kind = dict(entries.dtypes)["_value"]
    place = lambda c, i: F.transform(c, lambda x, at: F.struct(F.lit(i).alias("column"), at.alias("at"), x.alias("_key")))
    empty = F.array().cast(f"array<struct<column:int,at:int,_key:{dict(df.dtypes)[columns[0]][6:-1]}>>")
    listed = F.flatten(F.array(*(F.coalesce(place(F.col(c), i), empty) for i, c in enumerate(columns))))
    none = F.lit(None).cast(f"struct<column:int,at:int,value:{kind}>")
    each = df.select(F.col(by).alias("_by"), F.explode(listed).alias("e")).select("_by", "e.*").where(F.col("_key").isNotNull()).join(entries, "_key")
    elements = each.select("_by", F.struct("column", "at", F.col("_value").alias("value")).alias("e"), F.lit(None).cast(df.schema).alias("_row"))
    rows = df.select(F.col(by).alias("_by"), none.alias("e"), F.struct(*df.columns).alias("_row"))
    met = elements.unionByName(rows).groupBy("_by").agg(F.first("_row", ignorenulls=True).alias("_row"), F.array_sort(F.collect_list("e")).alias("_all"))
    own = lambda i: F.transform(F.filter("_all", lambda e: e.column == i), lambda e: e.value)
    out = [F.when(F.col(f"_row.{c}").isNotNull(), own(columns.index(c))).alias(c) if c in columns else F.col(f"_row.{c}").alias(c) for c in df.columns]
    return met.select(*out)


def with_translated_values(df: DataFrame, pairs: DataFrame, key: str, value: str, *columns: str, order: str | None = None) -> DataFrame:
    """df with the identifiers in some plain columns translated, null where there is no translation; rows and their number stay.

    Each column meets the dictionary by an ordinary join. Where lists are made of rows, this comes before: a small dictionary is sent to the tasks, and
    rows that are dealt by the key of their lists stay where they are.
    """
    entries = last_entries(pairs, key, value, order)
    for c in columns:
        found = entries.select(F.col("_key").alias(c), F.col("_value").alias("_found"))
        df = df.join(found, c, "left").select(*(F.col("_found").alias(c) if x == c else x for x in df.columns))
    return df


def traversed_by_chain(legs: DataFrame) -> DataFrame:
    """(chain_id, stops): the stops of a chain's legs (chain_id, leg, status, stops) with status ok, leg after leg."""
    ok = legs.where("status = 'ok'").groupBy("chain_id").agg(F.sort_array(F.collect_list(F.struct("leg", "stops"))).alias("_l"))
    return ok.select("chain_id", F.flatten(F.col("_l.stops")).alias("stops"))


def first_alternatives(alternatives: Column, n: int = 10) -> Column:
    """The first n of a request's alternatives in the order of the router, which isn't changed."""
    return F.slice(alternatives, 1, n)


def pairs_of(chains: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Each chain with each alternative of its origin and destination (od_id); chains without any go.

    Columns besides od_id get the prefixes c_ and a_. The join is on od_id; adaptive execution splits od_ids with many chains.
    """
    c = chains.select("od_id", *(F.col(x).alias(f"c_{x}") for x in chains.columns if x != "od_id"))
    a = alternatives.select("od_id", *(F.col(x).alias(f"a_{x}") for x in alternatives.columns if x != "od_id"))
    return c.join(a, "od_id")


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def with_similarity(pairs: DataFrame) -> DataFrame:
    """pairs (c_ and a_: routes, modes, board, alight, stops, legs, duration) with the measures, sim_total, exact_match and transfer_match.

    Without traversed stops of the chain its boardings and alightings stand for them.
    """
    c, a = (lambda x: F.col(f"c_{x}")), (lambda x: F.col(f"a_{x}"))
    ends = {"c": F.concat(c("board"), c("alight")), "a": F.concat(a("board"), a("alight"))}
    some = F.size(c("stops")) > 0
    full, at_ends = arrays.jaccard(c("stops"), a("stops")), arrays.jaccard(ends["c"], ends["a"])
    transfers = lambda legs: F.greatest(legs - 1, F.lit(0))
    rows = pairs.withColumns({
        "sim_route_seq": arrays.lcs_similarity(c("routes"), a("routes")), "sim_mode_seq": arrays.lcs_similarity(c("modes"), a("modes")),
        "sim_jaccard": F.when(some, full).otherwise(at_ends),
        "sim_lcs": arrays.lcs_similarity(F.when(some, c("stops")).otherwise(ends["c"]), F.when(some, a("stops")).otherwise(ends["a"])),
        "sim_boarding_alighting": arrays.pair_match_rate(c("board"), c("alight"), a("board"), a("alight")),
        "sim_time": arrays.time_similarity(c("duration"), a("duration")),
        "exact_match": (_same(c("routes"), a("routes")) & _same(c("modes"), a("modes")) & _same(c("board"), a("board")) & _same(c("alight"), a("alight"))).cast("int"),
        "transfer_match": (transfers(c("legs")) == transfers(a("legs"))).cast("int"), "transfer_diff": F.abs(transfers(c("legs")) - transfers(a("legs"))),
    })
    total = sum((F.col(f"sim_{name}") * w for name, w in WEIGHTS.items()), F.lit(0.0))
    return rows.withColumn("sim_total", total)


#: The share of each measure in the score of a baseline.
BASELINE = {"route_lcs": 0.5, "mode_lcs": 0.10, "jaccard": 0.30, "time_sim": 0.10}


def with_baseline_scores(pairs: DataFrame) -> DataFrame:
    """pairs (c_ and a_: routes, modes, duration) with the measures of a baseline, which needs no stops: exact, mode_match, route_lcs, mode_lcs,
    jaccard, time_sim and their weighted sum score. The alternative's modes are taken for SUBWAY or BUS; times compare to the chain's own."""
    c, a = (lambda x: F.col(f"c_{x}")), (lambda x: F.col(f"a_{x}"))
    modes = F.transform(a("modes"), lambda m: F.when(m.isin("SUBWAY", "RAIL"), "SUBWAY").otherwise("BUS"))
    time = F.when(c("duration") > 0, 1.0 - F.least(F.abs(c("duration") - a("duration")) / c("duration"), F.lit(1.0))).otherwise(0.0)
    both_empty = lambda x, y, value: F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(value)
    rows = pairs.withColumns({
        "exact": _same(c("routes"), a("routes")).cast("int"), "mode_match": _same(c("modes"), modes).cast("int"),
        "route_lcs": arrays.lcs_ratio(c("routes"), a("routes")), "mode_lcs": arrays.lcs_ratio(c("modes"), modes),
        "jaccard": both_empty(c("routes"), a("routes"), arrays.jaccard(c("routes"), a("routes"))), "time_sim": time,
    })
    return rows.withColumn("score", sum((F.col(n) * w for n, w in BASELINE.items()), F.lit(0.0)))


def with_attributes(choice_set: DataFrame, attributes: DataFrame, *keys: str) -> DataFrame:
    """choice_set with the attributes of its alternatives; alternatives without any stay, with nulls."""
    return choice_set.join(attributes, list(keys), "left")


def encoded(value: Column, codes: dict[str, int]) -> Column:
    """The code of a category; null for others."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)), value)


def with_interactions(df: DataFrame, flag: str, *names: str) -> DataFrame:
    """df with flag * name for each name, called flag_name."""
    return df.withColumns({f"{flag}_{n}": F.col(flag) * F.col(n) for n in names})
