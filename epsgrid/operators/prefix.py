"""Exclusive prefix sums in a global order, without a window over one partition.

Rows are dealt by ranges of the order and written; sums run inside each range, and the totals of
the ranges before it, one row a range, are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epsgrid.staging import stage


def prefix_sums(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows before it. The order must be total."""
    dealt = stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = totals.withColumn("_before", F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).select("_range", "_before")
    rows = dealt.withColumn("_inside", F.sum(value).over(inside)).join(F.broadcast(before), "_range")  # one row a shuffle partition
    return rows.withColumn(out, (F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0))).cast("long")).drop("_range", "_before", "_inside")
