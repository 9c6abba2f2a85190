"""Schemas of linked structures and the checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: A list or forest: succ of a root is its own id. weight is the length of the step to succ, 0 at roots.
SUCC = StructType([StructField(c, LongType(), False) for c in ("id", "succ", "weight")])
#: A ranked element: its root, and its distance to it.
RANKED = StructType([StructField(c, LongType(), False) for c in ("id", "root", "rank")])
EDGES = StructType([StructField(c, LongType(), False) for c in ("src", "dst", "weight")])


class StructureError(ValueError):
    """The table is no forest: a repeated or negative id, a successor that is no id, or a cycle."""


def weighted(succ: DataFrame) -> DataFrame:
    """(id, succ, weight) as longs; a missing weight is 1, and a root's is always 0."""
    weight = F.col("weight").cast("long") if "weight" in succ.columns else F.lit(1).cast("long")
    own = succ.select(F.col("id").cast("long").alias("id"), F.col("succ").cast("long").alias("succ"), weight.alias("weight"))
    return own.withColumn("weight", F.when(F.col("id") == F.col("succ"), F.lit(0).cast("long")).otherwise(F.coalesce("weight", F.lit(1).cast("long"))))


def validate(succ: DataFrame) -> DataFrame:
    """Gives succ back if ids are unique and not negative and every successor is an id; else raises StructureError.

    Two shuffles by id and one action. Cycles are found while ranking.
    """
    each = succ.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    bad = each.filter("n > 1 or id is null or id < 0").select(F.lit("repeated, negative or null id").alias("why"), "id")
    lost = succ.select(F.col("succ").alias("id")).distinct().join(each, "id", "left_anti")
    found = bad.unionByName(lost.select(F.lit("successor that is no id").alias("why"), "id")).limit(1).collect()
    if found:
        raise StructureError(f"{found[0].why}: {found[0].id}")
    return succ
