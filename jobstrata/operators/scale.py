"""Order-dependent building blocks that never put one whole key into one task.

A window over a key that holds a third of all rows is one task doing a third of the work. Each helper here first
shrinks the data with a partially aggregated `groupBy` (per key and time or position bucket), runs the window over
those few summary rows, and brings the answer back with an equi-join that adaptive execution can split.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_segments(df: DataFrame, keys: Sequence[str], us: str, gap_us: int, *extra: Column) -> DataFrame:
    """Clusters of rows whose neighbours in time are at most `gap_us` apart, one row per (keys, bucket).

    Rows of one gap-wide bucket are always in one cluster, so only the first and last time of each bucket matter.
    Returns keys, bucket, cluster_start (first time of the cluster) and the `extra` aggregates."""
    per_bucket = (df.groupBy(*keys, bucket_of(F.col(us), gap_us).alias("bucket"))
                  .agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"), *extra))
    w = Window.partitionBy(*keys).orderBy("bucket")
    before = F.lag("_hi").over(w)
    opens = F.when(before.isNull() | (F.col("_lo") - before > gap_us), F.col("_lo"))
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (per_bucket.withColumn("_opens", opens)
            .withColumn("cluster_start", F.max("_opens").over(so_far)).drop("_opens"))


def bucket_of(us: Column, width_us: int) -> Column:
    return F.floor(us / F.lit(width_us)).cast("long")


def first_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, id_col: str,
                      flag: str) -> DataFrame:
    """Marks the first `k` rows of each group, keeps all rows.

    `rank <= k` is planned as a limit per group inside every map task, so at most k rows per group and task are
    shuffled; the k winners per group are then joined back by id."""
    w = Window.partitionBy(*group).orderBy(*order)
    top = (df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
           .select(id_col, F.lit(True).alias(flag)))
    return df.join(top, id_col, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def running_position(df: DataFrame, group: Sequence[str], pos: str, stride: int, out: str = "row_no") -> DataFrame:
    """1-based position inside the group ordered by the integer `pos`: rows before the bucket + rank inside it."""
    binned = df.withColumn("_bin", F.floor(F.col(pos) / F.lit(stride)).cast("long"))
    sizes = binned.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_bin").orderBy(pos)
    return (binned.join(offsets, [*group, "_bin"])
            .withColumn(out, F.col("_before") + F.row_number().over(inside)).drop("_bin", "_before"))


def running_total(df: DataFrame, group: Sequence[str], pos: str, value: Column, stride: int, out: str) -> DataFrame:
    """Sum of `value` over the rows before this one in the group; same two-level scheme."""
    binned = (df.withColumn("_bin", F.floor(F.col(pos) / F.lit(stride)).cast("long")).withColumn("_v", value))
    sums = binned.groupBy(*group, "_bin").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "_bin", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_bin").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return (binned.join(offsets, [*group, "_bin"])
            .withColumn(out, F.col("_before") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
            .drop("_bin", "_v", "_before"))
