"""Linked structures and graphs read out of ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.tables import dealt


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chains(rows: DataFrame, id_col: str, group: str, order: str | None = None) -> DataFrame:
    """(id, succ): the rows of each group as a list in order; the last is its root."""
    w = Window.partitionBy(group).orderBy(order or id_col)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.lead(id_col).over(w), F.col(id_col)).cast("long").alias("succ"))


def orders_chain(spark: SparkSession, folder: str) -> DataFrame:
    return chains(read(spark, folder, "orders"), "o_orderkey", "o_custkey")


def orders_chain_weighted(spark: SparkSession, folder: str) -> DataFrame:
    return orders_chain(spark, folder).withColumn("weight", F.col("succ") - F.col("id"))


def events_chain(spark: SparkSession, folder: str) -> DataFrame:
    return chains(read(spark, folder, "events"), "event_id", "user_id")


def keyed_path(ids: DataFrame, key: Column, cut: int | None = None, buckets: int = 64) -> DataFrame:
    """(id, succ): the ids as one list in order of key (unique, 0 to n - 1); cut ends a list after every key divisible by it.

    The next element is found by a join on key + 1, not by a sort of all. Its tasks are told by counted rows and its
    sides are never broadcast, for ids in order take few bytes in a shuffle.
    """
    rows, n = ids.withColumn("k", key).select("id", "k"), ids.count()
    nxt = dealt(rows.select((F.col("k") - 1).alias("k"), F.col("id").alias("next")), n, "k").hint("merge")
    step = F.col("next") if cut is None else F.when(F.col("k") % cut != 0, F.col("next"))
    return dealt(rows, n, "k").join(nxt, "k", "left").select("id", F.coalesce(step, F.col("id")).alias("succ"))


def numbered_orders(spark: SparkSession, folder: str) -> DataFrame:
    """(id, n): order keys, dense from 0, and their number."""
    own = read(spark, folder, "orders").select(F.col("o_orderkey").cast("long").alias("id"))
    return own.crossJoin(F.broadcast(own.agg(F.count(F.lit(1)).alias("n"))))


def path(spark: SparkSession, folder: str, kind: str = "identity", cut: int | None = None) -> DataFrame:
    """One list over all orders. kind: identity, permuted, or partial (every tenth id changes places with its like)."""
    tenth = F.floor((F.col("n") + 9) / 10).cast("long")
    key = {
        "identity": F.col("id"),
        "permuted": (F.col("id") * 102947 + 17) % F.col("n"),
        "partial": F.when(F.col("id") % 10 == 0, (F.expr("id div 10") * 7919 + 13) % tenth * 10).otherwise(F.col("id")),
    }[kind]
    return keyed_path(numbered_orders(spark, folder), key, cut)


REGION, NATION, SUPPLIER, CUSTOMER = 0, 100, 1_000_000, 10_000_000


def geography(spark: SparkSession, folder: str) -> DataFrame:
    """(id, succ): regions, nations below them, suppliers and customers below those; ids in ranges of their own."""
    part = lambda name, key, above, base, up: read(spark, folder, name).select((F.col(key) + base).cast("long").alias("id"), (F.col(above) + up).cast("long").alias("succ"))
    out = part("region", "r_regionkey", "r_regionkey", REGION, REGION).unionByName(part("nation", "n_nationkey", "n_regionkey", NATION, REGION))
    return out.unionByName(part("supplier", "s_suppkey", "s_nationkey", SUPPLIER, NATION)).unionByName(part("customer", "c_custkey", "c_nationkey", CUSTOMER, NATION))


def recursive_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(id, succ): each order below an earlier one, chosen by arithmetic on its keys."""
    own = read(spark, folder, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("c"))
    return own.select("id", F.when(F.col("id") > 0, F.expr("((id * id + 17) div 7 + c) % greatest(id, 1)")).otherwise(F.col("id")).alias("succ"))


PART = 10_000_000
#: Rows of lineitem that a task joins and tells apart. Spark would put parts together by their compressed bytes.
TASK_ROWS = 500_000


def purchases(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, weight), both ways, between customers and the parts they ordered, and vertices (id)."""
    items = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    tasks = max(spark.sparkContext.defaultParallelism, -(-items.count() // TASK_ROWS))
    items = items.repartition(tasks, "o_orderkey")
    own = read(spark, folder, "orders").select("o_orderkey", "o_custkey").join(items, "o_orderkey")
    pairs = own.select(F.col("o_custkey").cast("long").alias("c"), F.col("l_partkey").cast("long").alias("p")).repartition(tasks, "c", "p").distinct()
    weight = ((F.col("c") * 31 + F.col("p") * 17) % 1009).alias("weight")
    there = pairs.select(F.col("c").alias("src"), (F.col("p") + PART).alias("dst"), weight)
    back = pairs.select((F.col("p") + PART).alias("src"), F.col("c").alias("dst"), weight)
    people = read(spark, folder, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    parts = read(spark, folder, "part").select((F.col("p_partkey") + PART).cast("long").alias("id"))
    return there.unionByName(back), people.unionByName(parts)
