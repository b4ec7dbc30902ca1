"""Running totals without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def running_total(df: DataFrame, value: str, key: str = "i") -> DataFrame:
    """`df` with total, the sum of `value` up to each `key` (0-based positions, one row each).

    Sums run within blocks of positions; a sum over one row a block puts the blocks after each other.
    """
    block = F.expr(f"{key} div {BLOCK}L")
    df = df.withColumn("block", block)
    within = Window.partitionBy("block").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = df.groupBy("block").agg(F.sum(value).alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("head"))
    return df.withColumn("own", F.sum(value).over(within)).join(heads, "block").withColumn("total", F.col("own") + F.col("head")).drop("block", "own", "head")
