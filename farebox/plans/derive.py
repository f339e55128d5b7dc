"""Domain tables derived from the general tables, as DataFrames and as the SQL that the checks use."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ALTS_SQL = """alts0 AS (
  SELECT l_orderkey AS chain_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS alt_id,
         l_quantity AS t_ride, l_tax * 100 AS t_walk, CAST(l_suppkey % 4 AS DOUBLE) AS n_transfer, CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END AS d_subway,
         l_extendedprice AS cost, 1 - l_discount * 10 AS sim, l_partkey
  FROM lineitem),
alts AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY chain_id ORDER BY sim DESC, alt_id) = 1 THEN 1 ELSE 0 END AS choice FROM alts0)"""
CHAINS_SQL = "chains AS (SELECT o_orderkey AS chain_id, substr(o_orderpriority, 1, 1) AS user_type, CAST((o_orderkey * 37) % 86400 AS BIGINT) AS board_s FROM orders)"
#: Coefficients of the utility: pooled, and two types' own.
POOLED = {"t_ride": -0.03, "t_walk": -0.05, "n_transfer": -0.6, "d_subway": 0.25}
BETAS = {None: POOLED, "1": {"t_ride": -0.02, "t_walk": -0.08, "n_transfer": -0.9, "d_subway": 0.4}, "2": {"t_ride": -0.05, "t_walk": -0.03, "n_transfer": -0.3, "d_subway": 0.1}}


def _v(betas: dict[str, float]) -> str:
    return " + ".join(f"{n} * ({b})" for n, b in betas.items())


V_SQL = _v(POOLED)
SCORED_SQL = f"""{ALTS_SQL}, {CHAINS_SQL},
v AS (SELECT a.*, c.user_type, c.board_s, CASE c.user_type WHEN '1' THEN {_v(BETAS["1"])} WHEN '2' THEN {_v(BETAS["2"])} ELSE {V_SQL} END AS v FROM alts a JOIN chains c USING (chain_id)),
e AS (SELECT *, exp(v - max(v) OVER (PARTITION BY chain_id)) AS x FROM v),
scored AS (SELECT *, x / sum(x) OVER (PARTITION BY chain_id) AS p, count(*) OVER (PARTITION BY chain_id) AS n_alts FROM e)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a part that one task sorts.
PART_ROWS = 500_000


def parts(rows: DataFrame, part_rows: int = PART_ROWS) -> int:
    """How many parts leave about part_rows rows of a table to each. (They are counted from the footers of its files.)"""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / part_rows))


def dealt(rows: DataFrame, key: str, part_rows: int = PART_ROWS) -> DataFrame:
    """rows of a table by the hash of a key, in as many parts as leave about part_rows to each, so that what a task sorts and holds doesn't grow with
    the table. What groups, orders or joins by the key needs no other shuffle."""
    return rows.repartition(parts(rows, part_rows), key)


def alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from farebox.operators.choice import with_choice

    order = Window.partitionBy("chain_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    lines = dealt(read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "chain_id"), "chain_id")
    rows = lines.select(
        "chain_id", (F.row_number().over(order) - 1).cast("long").alias("alt_id"), F.col("l_quantity").alias("t_ride"), (F.col("l_tax") * 100).alias("t_walk"),
        (F.col("l_suppkey") % 4).cast("double").alias("n_transfer"), F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0).alias("d_subway"), F.col("l_extendedprice").alias("cost"),
        (1 - F.col("l_discount") * 10).alias("sim"), "l_partkey",
    )
    return with_choice(rows)


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chain_id"), F.substring("o_orderpriority", 1, 1).alias("user_type"), F.pmod(F.col("o_orderkey") * 37, F.lit(86_400)).alias("board_s"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from farebox.operators.choice import of_chain, utility_by_type, with_probability

    rows = alternatives(spark, sf_dir).join(chains(spark, sf_dir), "chain_id").withColumn("v", utility_by_type(BETAS))
    return with_probability(rows).withColumn("n_alts", F.count("*").over(of_chain()))
