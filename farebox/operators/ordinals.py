"""Numbers of rows in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farebox.sources.shared import written


def numbered(df: DataFrame, *order: str | Column, name: str = "ordinal", first: int = 0) -> DataFrame:
    """df with a column of consecutive numbers from first on, in the order given.

    Rows are dealt out by ranges of the order and written once; each range is numbered for itself, after the sum of the rows of the ranges
    before it. Only a count for each range is summed up in one task. Rows that are equal in the order are numbered as they stand in df, and
    so are split over ranges as well, however many they are. Nulls go where the order puts them; an empty table gives an empty one.
    """
    told = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(c) if isinstance(c, str) else c for c in order] + [F.col("_tie")]
    parts = written(told.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ordinals")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return parts.join(F.broadcast(before), "_part").withColumn(name, own + F.col("_before") + F.lit(first - 1).cast("long")).select(*df.columns, name)
