"""Samples and splits in the order of a hash: the same rows in every run and every engine, and exact numbers without a task for each stratum."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farebox.operators.ordinals import numbered
from farebox.sources.shared import written

#: Digits of the hash by which strata are counted first: a stratum has as many as 16 ** DIGITS parts, of which one is ordered.
DIGITS = 4
#: Strata whose bounds go to every task; those of more are joined.
MANY = 100_000


def hash_order(*key: str) -> Column:
    """The hash of a key, of several columns joined by a bar; that of a null key comes first."""
    text = F.col(key[0]).cast("string") if len(key) == 1 else F.concat_ws("|", *key)
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


def _of_stratum(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """rows with what was found for their stratum (_s; found: _t and more); a null stratum is one like any other."""
    small = F.broadcast(found) if found.count() <= MANY else found
    return rows.join(small, rows["_s"].eqNullSafe(found["_t"]), how).drop("_t")


def with_taken(df: DataFrame, stratum: Column, quota: Callable[[Column, Column], Column], *key: str, digits: int = DIGITS) -> DataFrame:
    """df with _taken: whether a row is among the first rows of its stratum by the hash of its key, as many as quota(rows of the stratum, stratum) says.

    Rows are counted by stratum and first digits of the hash, which combines before the shuffle. Sums tell in which part a stratum's quota
    ends: parts before it are taken whole, parts after it aren't, and only the rows of that part are put in order, all strata's in one
    numbering by ranges. So no task holds a stratum, whatever its size, and rows that share a key are split as well.
    """
    rows = df.withColumns({"_s": stratum, "_h": hash_order(*key)})
    part = F.substring("_h", 1, digits)
    counts = rows.groupBy("_s", part.alias("_p")).agg(F.count("*").alias("_c"))
    own = Window.partitionBy("_s")
    sums = counts.withColumns({"_n": F.sum("_c").over(own), "_to": F.sum("_c").over(own.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))})
    asked = sums.withColumn("_q", F.least(quota(F.col("_n"), F.col("_s")).cast("long"), F.col("_n"))).where("_to - _c < _q and _q <= _to")
    edges = written(asked.select(F.col("_s").alias("_t"), F.col("_p").alias("_edge"), (F.col("_q") - F.col("_to") + F.col("_c")).alias("_left")), "edges")
    met = _of_stratum(rows, edges, "left")
    within = met.where(part == F.col("_edge"))
    turned = numbered(within, "_s", "_h", *key, name="_turn")
    first = written(turned.groupBy(F.col("_s").alias("_t")).agg(F.min("_turn").alias("_first")), "first")
    ranked = _of_stratum(turned, first, "inner").withColumn("_taken", F.col("_turn") - F.col("_first") < F.col("_left"))
    whole = met.where((part != F.col("_edge")) | F.col("_edge").isNull()).withColumn("_taken", F.coalesce(part < F.col("_edge"), F.lit(False)))
    return whole.select(*df.columns, "_taken").unionByName(ranked.select(*df.columns, "_taken"))


def _shares(shares: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in shares.items() for x in kv))


def stratified_sample(df: DataFrame, stratum: str, key: str, shares: dict, total: int) -> DataFrame:
    """For each stratum its share of total rows, the first ones by hash, with the inverse-probability weight (population over sample share)."""
    quota = lambda n, s: F.floor(F.coalesce(F.try_element_at(_shares(shares), s), F.lit(0.0)) * total)
    taken = with_taken(df, F.col(stratum), quota, key).where("_taken").drop("_taken")
    size, sampled = (x.groupBy(stratum).agg(F.count("*").alias(n)) for x, n in ((df, "_size"), (taken, "_some_of")))
    both = size.join(sampled, stratum).withColumn("_all", F.sum("_size").over(Window.partitionBy())).withColumn("_some", F.sum("_some_of").over(Window.partitionBy()))
    weight = (F.col("_size") / F.col("_all")) / (F.col("_some_of") / F.col("_some"))
    return taken.join(F.broadcast(both.select(stratum, weight.alias("weight"))), stratum)  # at most len(shares) rows


def filled_quotas(sizes: dict, shares: dict, total: int) -> dict:
    """How many rows each stratum gives: its share of total rounded down, the last stratum the rest; what a stratum lacks, the others give as far
    as they can, in the order of shares."""
    names = list(shares)
    aims = [int(total * shares[s]) for s in names[:-1]]
    aims.append(total - sum(aims))
    given = {s: min(max(a, 0), sizes.get(s, 0)) for s, a in zip(names, aims, strict=True)}
    for s in names:
        given[s] += min(total - sum(given.values()), sizes.get(s, 0) - given[s])
    return given


def filled_sample(df: DataFrame, stratum: Column, key: str, shares: dict, total: int) -> DataFrame:
    """total rows by the shares of their strata, with short strata filled up from the others, and the weight that undoes both: the share of the
    population over the share of the sample. Strata that shares doesn't name take no part. One count for each share comes to the driver."""
    known = df.withColumn("_k", stratum).where(F.col("_k").isin(*shares))
    sizes = {r[0]: r[1] for r in known.groupBy("_k").count().collect()}
    given = filled_quotas(sizes, shares, total)
    everyone, some = sum(sizes.values()), sum(given.values())
    weights = {s: (sizes[s] / everyone) / (n / some) for s, n in given.items() if n}
    taken = with_taken(known, F.col("_k"), lambda n, s: F.try_element_at(_shares(given), s), key).where("_taken")
    return taken.withColumn("weight", F.try_element_at(_shares(weights or {s: 1.0 for s in shares}), F.col("_k"))).drop("_k", "_taken")


def split_share(key: str) -> Column:
    """A number in [0, 1) for each key: rows below the training share train. No shuffle, and no key on both sides."""
    return F.conv(F.substring(hash_order(key), 1, 8), 16, 10).cast("double") / 4294967296.0


def topped_up_sample(df: DataFrame, stratum: Column, key: str, total: int) -> DataFrame:
    """total rows: of each stratum max(1, floor(its share of total)), the first ones by hash; then rows go, or others come, in the order of the
    hash over all strata until there are total rows (all of them, if there are fewer). Each task keeps the first `total` rows at most.
    """
    n = df.count()
    quota = lambda size, _: F.greatest(F.lit(1), F.floor(size / F.lit(float(max(n, 1))) * total))
    rows = with_taken(df, stratum, quota, key).withColumn("_h", hash_order(key))
    return rows.orderBy((~F.col("_taken")).cast("int"), "_h", key).limit(total).drop("_h", "_taken")


def proportional_groups(df: DataFrame, kind: str, group: list[str], share: float) -> DataFrame:
    """The rows of some groups: of each kind ceil(share * its groups), the first ones by the hash of the group. Groups stay whole; null is a kind
    and a group like any other."""
    keys = df.select(kind, *group).distinct()
    taken = with_taken(keys, F.col(kind), lambda n, _: F.ceil(n * F.lit(share)), *group).where("_taken")
    taken = taken.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate([kind, *group])))
    same = F.lit(True)
    for i, c in enumerate([kind, *group]):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return df.join(taken, same, "left_semi")


def stratified_split(df: DataFrame, stratum: str, key: str, share: float) -> DataFrame:
    """df with part: of each stratum exactly floor(share * n) rows train, the first ones by the hash of their key; the others test."""
    taken = with_taken(df, F.col(stratum), lambda n, _: F.floor(n * F.lit(share)), key)
    return taken.withColumn("part", F.when(F.col("_taken"), "train").otherwise("test")).drop("_taken")
