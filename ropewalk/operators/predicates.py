"""Initial states, root and leaf checks, list checks and reversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import dealt
from ..schema import weighted


def init_state(succ: DataFrame) -> DataFrame:
    """(id, root, rank, done): one step taken."""
    return weighted(succ).select("id", F.col("succ").alias("root"), F.col("weight").alias("rank"), (F.col("id") == F.col("succ")).alias("done"))


def roots(succ: DataFrame) -> DataFrame:
    return succ.filter("succ = id").select("id")


def active(succ: DataFrame) -> DataFrame:
    """Elements whose rank isn't known at the start."""
    return succ.filter("succ != id").select("id")


def leaves(succ: DataFrame, proper_only: bool = False, rows: int = 0) -> DataFrame:
    """Elements that no other points to; an isolated root is one unless proper_only. rows: how many succ has, if known."""
    pointed = dealt(succ.filter("succ != id").select(F.col("succ").alias("id")), rows, "id").distinct()
    own = succ.filter("succ != id") if proper_only else succ
    return dealt(own.select("id"), rows, "id").join(pointed.hint("merge"), "id", "left_anti")


def in_degrees(succ: DataFrame) -> DataFrame:
    """(id, degree): how many others point to each element."""
    pointed = succ.filter("succ != id").groupBy(F.col("succ").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return succ.select("id").join(pointed, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def list_check(succ: DataFrame) -> DataFrame:
    """One row: is_list, true if no element has more than one predecessor; branchings counts those that have."""
    many = succ.filter("succ != id").groupBy("succ").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return many.agg(F.count(F.lit(1)).alias("branchings")).select((F.col("branchings") == 0).alias("is_list"), "branchings")


def is_list(succ: DataFrame) -> bool:
    many = succ.filter("succ != id").groupBy("succ").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return many.limit(1).isEmpty()


def reverse_list(succ: DataFrame) -> DataFrame:
    """(id, succ, weight) with every step turned round; heads become roots. For lists only."""
    own = weighted(succ)
    back = own.filter("succ != id").select(F.col("succ").alias("id"), F.col("id").alias("pred"), "weight")
    return own.select("id").join(back, "id", "left").select("id", F.coalesce("pred", "id").alias("succ"), F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))
