"""Scans, differences, neighbours on a circle, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclusive_scan(counts: DataFrame, by: str, value: str) -> DataFrame:
    """counts with offset, the sum of value before each row. For tables of parts, not of elements."""
    line = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("offset", (F.sum(value).over(line) - F.col(value)).cast("long"))


def inclusive_scan(counts: DataFrame, by: str, value: str) -> DataFrame:
    line = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("upto", F.sum(value).over(line).cast("long"))


def differences(offsets: DataFrame, by: str, value: str) -> DataFrame:
    """The size of each part from its offset; the last has none."""
    return offsets.withColumn("size", F.lead(value).over(Window.orderBy(by)) - F.col(value))


def circle(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with before and after on the circle of each group."""
    w = Window.partitionBy(group).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("before", F.coalesce(F.lag(order).over(w), F.last(order).over(whole))).withColumn("after", F.coalesce(F.lead(order).over(w), F.first(order).over(whole)))


def sample_by_key(rows: DataFrame, key: Column, k: int) -> DataFrame:
    """k rows with the least key; a hash of the id gives a sample that any retry repeats."""
    return rows.withColumn("__key", key).orderBy("__key", "id").limit(k).drop("__key")


def first_unvisited(ids: DataFrame, seen: DataFrame, cursor: int = 0) -> DataFrame:
    """One row: the least id from cursor on that isn't in seen (null: none)."""
    return ids.filter(F.col("id") >= cursor).join(seen, "id", "left_anti").agg(F.min("id").alias("id"))


def partition_sizes(df: DataFrame) -> DataFrame:
    """(part, n) as the rows lie now."""
    return df.groupBy(F.spark_partition_id().cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"))


def size_stats(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.sum("n").cast("long").alias("total_size"))


def rebalance(df: DataFrame, parts: int, skew: float = 1.0) -> DataFrame:
    """Deals the rows into ranges of ids of like size if the largest part has more than skew times the mean."""
    s = size_stats(partition_sizes(df)).withColumn("mean", F.col("total_size") / parts).first()
    return df.repartitionByRange(parts, "id") if s.total_size and s.max_size > skew * s.mean else df
