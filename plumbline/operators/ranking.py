"""Running sums and ranks that never gather one group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_prefix(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group``, in the order of (``bucket``, ``order``).

    A group is cut into buckets, so a group of any size is spread over tasks: sums per bucket are pre-aggregated, their
    running sums (one row per group and bucket) are added to the running sum inside each bucket. NULL group keys form a
    group of their own; NULL values count as 0.
    """
    v = F.coalesce(value, F.lit(0)).cast("long")
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(v).alias("_pre"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.coalesce(F.sum("_pre").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_in", F.coalesce(F.sum(v).over(within), F.lit(0)))
    cond = None
    for k in keys:
        c = inner[k].eqNullSafe(base[f"_b_{k}"])
        cond = c if cond is None else cond & c
    return inner.join(base, cond, "left").withColumn(out, F.col("_in") + F.col("_base")).drop("_in", "_base", *[f"_b_{k}" for k in keys])
