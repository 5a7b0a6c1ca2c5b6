"""Running totals and row numbers over whole tables without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathlens.sources.storage import settle


def running(df: DataFrame, key: str, weight: str) -> DataFrame:
    """df with `before`: the sum of `weight` over rows with a lower key. Keys are distinct."""
    part = F.spark_partition_id().alias("part")
    dealt = settle(df.repartitionByRange(key).select("*", part))
    sums = dealt.groupBy("part").agg(F.sum(weight).alias("w"))
    unbounded = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    first = sums.select("part", F.coalesce(F.sum("w").over(unbounded), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(first), "part").withColumn("before", F.col("base") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).drop("part", "base")
