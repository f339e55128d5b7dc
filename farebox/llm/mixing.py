"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Targets: sources in order of their code points, null last, weigh 3, 1, 2, repeating, and share 150 % of all words. No target
passes twice its source's words; what is above is shared anew by weight. (Closed form: in order of cap over weight, the first
sources are full and the others get a common level times their weight.)

Copies: a document of a source with target t and s words gets floor(t / s) copies, and one more with the probability of the
rest. Which ones get it is decided in pairs: the words expected of two documents move from one to the other, at
random in either direction so that no probability changes on average, until one of the two is decided. The undecided one
meets the next document. Blocks of about ARITY documents are folded this way, their remainders form the blocks of the
next level, and the last remainder of a source is rounded to the nearer side. So the words taken of a source differ from its
target by at most half of one document. The random numbers are hashes of the documents met: reruns agree.

Skew: blocks are dealt by hash and hold about ARITY documents whatever the source; a source's number of blocks grows with it.
Rows that agree in source, doc_id and words are counted before any shuffle and decided as one with a count.

Edge cases: a null text has no words and takes none; documents without words get their whole copies and take 0 words; a null
source is a source; repeated rows are separate documents; very long texts count whole; other columns stay as they are, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farebox.llm.common import WORD, table, text_or_empty, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
ARITY = 64
SEED = 6


def words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size), one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    weighed = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), turn)).withColumn("_full", F.lit(cap) * F.col("source_size"))
    fill = Window.orderBy(F.col("_full") / F.col("_w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    whole = F.lit(share) * F.sum("source_size").over(every)
    level = (whole - F.coalesce(F.sum("_full").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    found = weighed.withColumn("_level", level)
    first = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_full"), F.struct(F.col("_full") / F.col("_w"), "_level"))).over(every)
    return found.withColumn("_level", first["_level"]).select("source", "source_size", F.least("_full", F.coalesce(F.col("_level") * F.col("_w"), F.col("_full"))).alias("target"))


def _uniform(*of: Column) -> Column:
    """A number in [0, 1) from the hash of the columns."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _meet(acc: Column, x: Column, level: int) -> Column:
    """The undecided document acc meets x. One of them is decided; if it gets its copy, it joins acc.chosen."""
    p, s, q, t = acc.p, acc.s, x.p, x.s
    rise_acc, fall_x = (F.lit(1.0) - p) * s, q * t
    fall_acc, rise_x = p * s, (F.lit(1.0) - q) * t
    to_acc, to_x = F.least(rise_acc, fall_x), F.least(fall_acc, rise_x)
    up = _uniform(acc.id, s, x.id, t, F.lit(SEED + level)) * (to_acc + to_x) < to_x

    def state(of: Column, prob: Column, chosen: Column) -> Column:
        return F.struct(of.id.alias("id"), of.s.alias("s"), prob.alias("p"), chosen.alias("chosen"))

    def one(of: Column) -> Column:
        return F.array_append(acc.chosen, F.struct(of.id.alias("id"), of.s.alias("s")))

    rising = F.when(rise_acc <= fall_x, state(x, q - to_acc / t, one(acc))).otherwise(state(acc, p + to_acc / s, acc.chosen))
    falling = F.when(fall_acc <= rise_x, state(x, q + to_x / t, acc.chosen)).otherwise(state(acc, p - to_x / s, one(x)))
    return F.when(p.isNull(), state(x, q, acc.chosen)).when(up, rising).otherwise(falling)


def _fold(units: DataFrame, level: int) -> DataFrame:
    """units (source, n, id, s, p) of one level: for each block (source, n, left, chosen)."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / float(ARITY ** (level + 1)))).cast("long")
    h = F.xxhash64("id", "s", F.lit(SEED * 1000 + level))
    dealt = units.select("source", "n", F.pmod(h, blocks).alias("block"), F.struct(h.alias("h"), "id", "s", "p").alias("unit"))
    met = dealt.groupBy("source", "n", "block").agg(F.sort_array(F.collect_list("unit")).alias("units"))
    none = "struct<id:bigint,s:bigint,p:double,chosen:array<struct<id:bigint,s:bigint>>>"
    start = F.struct(F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("s"), F.lit(None).cast("double").alias("p"), F.array().cast("array<struct<id:bigint,s:bigint>>").alias("chosen"))
    return met.select("source", "n", F.aggregate("units", start.cast(none), lambda acc, x: _meet(acc, x, level).cast(none)).alias("left"))


def decide(rows: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """rows (doc_id, source, size), one a document: for each (doc_id, source, size) its count, source_size, target, the copies that each of
    its rows gets (low), and how many of the rows get one more (more)."""
    keyed = written(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("count")), "sizes")
    sources = keyed.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"), F.count("*").alias("n"))
    aims = written(targets(sources, share, cap, weights).withColumnRenamed("source", "_s").join(sources.select("source", "n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "targets")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    planned = keyed.join(aims.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    planned = planned.withColumn("low", F.floor(rate)).withColumn("_e", (rate - F.col("low")) * F.col("count")).withColumn("sure", F.floor("_e")).withColumn("p", F.col("_e") - F.col("sure"))
    units = planned.where((F.col("p") > 0) & (F.col("size") > 0)).select("source", "n", F.col("doc_id").alias("id"), F.col("size").alias("s"), "p")
    most = aims.agg(F.max("n")).first()[0] or 0
    levels = 1
    while ARITY**levels < most:
        levels += 1
    chosen = None
    for level in range(levels):
        folded = written(_fold(units, level), f"level{level}")
        units = folded.select("source", "n", "left.id", "left.s", "left.p")
        got = folded.select("source", F.explode("left.chosen").alias("c")).select("source", "c.id", "c.s")
        chosen = got if chosen is None else chosen.union(got)
    chosen = chosen.union(units.where("p >= 0.5").select("source", "id", "s")).select(F.col("source").alias("_s"), F.col("id").alias("_id"), F.col("s").alias("_size"), F.lit(1).alias("one"))
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size"))
    return planned.join(chosen, same, "left").select("doc_id", "source", "size", "count", "source_size", "target", "low", (F.col("sure") + F.coalesce("one", F.lit(0))).alias("more"))


def _sized(df: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"))


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """df with each row as often as the mix takes it: not at all, once or repeatedly."""
    decided = decide(_sized(df, doc_id, source, text), share, cap, weights)
    decided = decided.select(F.xxhash64("doc_id", "source", "size").alias("hash"), F.struct("doc_id", "source", "size").alias("of"), "low", "more")
    own = F.struct(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"))
    rows = df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("all"), own.alias("own"), F.xxhash64(text).alias("tie"))
    rows = rows.select("all", "own", "tie", F.xxhash64("own.doc_id", "own.source", "own.size").alias("key"))
    # one join for rows that agree and others, on what the window deals by (structs with equal nulls are equal): texts are shuffled once
    placed = rows.join(decided, (F.col("key") == F.col("hash")) & (F.col("own") == F.col("of")))
    turn = F.row_number().over(Window.partitionBy("hash", "of").orderBy("tie"))
    turned = placed.withColumn("turn", turn).select("all", (F.col("low") + (F.col("turn") <= F.col("more")).cast("long")).alias("n"))
    return turned.where("n > 0").select("all", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("all.*")


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decide(_sized(table(spark, sf_dir, "documents"), "doc_id", "source", "text"))
    rows = found.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    taken = (F.col("low") + (F.col("turn") <= F.col("more")).cast("long")) * F.col("size")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")
