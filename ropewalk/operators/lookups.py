"""Requests and replies as equi-joins, packing to dense ids, and set operations on work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import dealt, keep


def ask(requests: DataFrame, state: DataFrame, key: str, distinct_first: bool = False) -> DataFrame:
    """requests with the columns of state (keyed by id) for their key.

    distinct_first asks once for each key: right where many requests share few keys, as in trees of high degree.
    """
    if not distinct_first:
        return requests.join(state.withColumnRenamed("id", key), key)
    replies = requests.select(key).distinct().join(state.withColumnRenamed("id", key), key)
    return requests.join(replies, key)


#: Rows that are broadcast, at most, and shares of the requests that a hot key has, at least one in so many.
FEW, HOT_SHARE = 1 << 16, 2500


def meet(requests: DataFrame, state: DataFrame, key: str, rows: int, hot: bool = False, how: str = "inner", of: int = 0) -> DataFrame:
    """requests, of which there are about rows, joined with state, unique in key, by key; state has rows or of at most.

    Which side is broadcast is told by rows, not by the sizes of files: those of well compressed tables are a tenth and
    less of what the driver would hold. Nor do they tell a task's rows (see dealt). hot reduces the replies to keys that are asked for, and those that have more
    than one in HOT_SHARE of the requests are broadcast, so that no task gets all that ask for one.
    """
    if rows <= FEW:
        return F.broadcast(requests).join(state, key) if how == "inner" else requests.join(state.join(F.broadcast(requests.select(key).distinct()), key, "left_semi").hint("merge"), key, how)
    many = max(rows, of)
    if not hot:
        return dealt(requests, many, key).join(dealt(state, many, key).hint("merge"), key, how)
    keys = keep(requests.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > max(16, rows // HOT_SHARE)).select(key))
    wanted = requests.join(F.broadcast(keys), key, "left_anti")
    few = keep(state.join(F.broadcast(keys), key, "left_semi"))
    apart = requests.join(F.broadcast(keys), key, "left_semi").join(F.broadcast(few), key, how)
    replies = dealt(wanted.select(key).distinct(), many, key).join(dealt(state, many, key).hint("merge"), key)
    return apart.unionByName(dealt(wanted, many, key).join(replies.hint("merge"), key, how))


def neighbour_values(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(dst, src, value): what each vertex learns from its neighbours."""
    return edges.select("src", "dst").join(values.withColumnRenamed("id", "src"), "src").select("dst", "src", "value")


def dense_ids(ids: DataFrame, parts: int = 64) -> DataFrame:
    """(id, dense): places in order of id, from 0.

    Quantiles cut the ids into ranges of like size, however they lie, and counts give each range's offset; only
    inside a range are ids numbered, so no task sees them all. Large tables want more parts.
    """
    cuts = ids.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 100 * parts).alias("cuts"))
    placed = ids.select("id").crossJoin(F.broadcast(cuts)).select("id", F.size(F.filter("cuts", lambda c: c < F.col("id"))).alias("range"))
    counts = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("offset"))  # parts rows
    own = placed.withColumn("k", F.row_number().over(Window.partitionBy("range").orderBy("id")) - 1)
    return own.join(F.broadcast(offsets), "range").select("id", (F.col("offset") + F.col("k")).alias("dense"))


def pack(succ: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The structure on the active ids in dense ids, and (id, dense).

    A step that leaves the active ids becomes a root.
    """
    names = dense_ids(active)
    own = succ.join(names, "id").select("dense", "succ", "weight")
    to = names.select(F.col("id").alias("succ"), F.col("dense").alias("to"))
    root = F.col("to").isNull() | (F.col("to") == F.col("dense"))
    weight = F.when(root, F.lit(0)).otherwise(F.col("weight")).cast("long")
    packed = own.join(to, "succ", "left").select(F.col("dense").alias("id"), F.coalesce("to", "dense").alias("succ"), weight.alias("weight"))
    return packed, names


def unpack(ranked: DataFrame, names: DataFrame) -> DataFrame:
    """(id, root, rank) in the ids from before packing."""
    back = names.select(F.col("dense").alias("root"), F.col("id").alias("root_id"))
    return ranked.join(names.select(F.col("dense").alias("id"), F.col("id").alias("own")), "id").join(back, "root").select(F.col("own").alias("id"), F.col("root_id").alias("root"), "rank")


def append(*lists: DataFrame) -> DataFrame:
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out


def without(ids: DataFrame, seen: DataFrame) -> DataFrame:
    return ids.join(seen, "id", "left_anti")


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, low, high) of ranges (part, low, high), both sorted and gapless, that meet: by their bounds, not by pairs.

    Every common range begins where a range of either side begins, so the begins alone are merged and filled forward.
    """
    none, part = F.lit(None).cast("long"), F.col("part")
    marks = left.select("low", "high", part.alias("l"), none.alias("r")).unionByName(right.select("low", "high", none.alias("l"), part.alias("r")))
    high = [F.max(F.when(F.col(side).isNotNull(), F.col("high"))).alias(f"{side}h") for side in ("l", "r")]
    begins = marks.groupBy("low").agg(F.max("l").alias("l"), F.max("r").alias("r"), *high)
    line = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    filled = begins.select("low", *(F.last(c, ignorenulls=True).over(line).alias(c) for c in ("l", "r", "lh", "rh")))
    return filled.select("l", "r", "low", F.least("lh", "rh").alias("high")).filter("low < high")
