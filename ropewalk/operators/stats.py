"""Statistics of ranked structures, verification and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_ratio
from ..schema import weighted


def basic_stats(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.count(F.when(F.col("root") == F.col("id"), 1)).alias("num_trees"), F.max("rank").alias("max_rank"), F.avg("rank").alias("avg_rank"))


def tree_stats(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.max("rank").alias("max_rank"), F.sum("rank").alias("rank_sum"))


def extensive_stats(ranked: DataFrame) -> DataFrame:
    """One row; averages over nothing are 0. A tree is nontrivial if it has more than its root."""
    big = F.col("size") > 1
    trees = tree_stats(ranked).agg(
        F.count(F.lit(1)).alias("num_trees"),
        F.count(F.when(big, 1)).alias("num_nontrivial"),
        F.coalesce(F.sum(F.when(big, F.col("size"))), F.lit(0)).alias("nontrivial_size_sum"),
        F.coalesce(F.sum(F.when(big, F.col("rank_sum"))), F.lit(0)).alias("nontrivial_rank_sum"),
        F.coalesce(F.max("size"), F.lit(0)).alias("max_size"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("__size"),
    )
    return trees.select(
        *trees.columns[:-1],
        safe_ratio(F.col("__size"), F.col("num_trees")).alias("avg_size"),
        safe_ratio(F.col("nontrivial_size_sum"), F.col("num_nontrivial")).alias("nontrivial_avg_size"),
        safe_ratio(F.col("nontrivial_rank_sum"), F.col("nontrivial_size_sum")).alias("nontrivial_avg_rank"),
    )


def size_histogram(ranked: DataFrame) -> DataFrame:
    """(size, max_depth, trees): how many trees have which size and depth."""
    return tree_stats(ranked).groupBy("size", F.col("max_rank").alias("max_depth")).agg(F.count(F.lit(1)).alias("trees"))


def stats(ranked: DataFrame, level: str) -> DataFrame | None:
    """level: none, basic, extensive or extensive-reduced-output (without the sums)."""
    if level == "none":
        return None
    if level == "basic":
        return basic_stats(ranked)
    out = extensive_stats(ranked)
    return out.drop("nontrivial_size_sum", "nontrivial_rank_sum") if level == "extensive-reduced-output" else out


def mismatches(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows on which two rankings differ, elements that only one has included."""
    other = expected.select("id", F.col("root").alias("root_"), F.col("rank").alias("rank_"))
    return ranked.join(other, "id", "full").filter(~(F.col("root").eqNullSafe(F.col("root_")) & F.col("rank").eqNullSafe(F.col("rank_"))))


def violations(succ: DataFrame, ranked: DataFrame) -> DataFrame:
    """Elements whose rank and root don't follow from their successor's; no other ranking is needed."""
    own = weighted(succ).join(ranked, "id", "left")
    nxt = ranked.select(F.col("id").alias("succ"), F.col("root").alias("next_root"), F.col("rank").alias("next_rank"))
    end = F.col("root").eqNullSafe(F.col("id")) & F.col("rank").eqNullSafe(F.lit(0))
    step = F.col("root").eqNullSafe(F.col("next_root")) & F.col("rank").eqNullSafe(F.col("next_rank") + F.col("weight"))
    return own.join(nxt, "succ", "left").filter(~F.when(F.col("id") == F.col("succ"), end).otherwise(step)).select("id")


def traces(ranked: DataFrame) -> DataFrame:
    """(root, trace): the elements of each list from its head to its root. For lists short enough to be read."""
    return ranked.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("rank", "id")), asc=False).alias("t")).select("root", F.array_join(F.transform("t", lambda x: x["id"].cast("string")), " -> ").alias("trace"))
