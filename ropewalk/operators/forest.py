"""Euler tours of forests, reversed trees, and proxies for vertices of high degree.

A tour's elements are directed edges. The step from a child v up to its parent is element 2 v, the step down to v is
2 v + 1; a root r has no step up, and 2 r is the element at which its tour ends.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import keep
from ..schema import weighted
from .doubling import doubling


def reversed_tree(succ: DataFrame, back_edges: bool = False) -> DataFrame:
    """(src, dst): from parents to children; with back_edges the other way too."""
    down = succ.filter("id != succ").select(F.col("succ").alias("src"), F.col("id").alias("dst"))
    return down.unionByName(down.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if back_edges else down


def with_proxies(succ: DataFrame, degree: int = 16, fan: int = 16) -> tuple[DataFrame, DataFrame]:
    """(id, succ, weight) in which no vertex has more than about degree or fan children, and (id, of) of the proxies.

    The children of a vertex of higher degree hang on fan proxies, dealt by hash, which hang on it with weight 0.
    """
    own = weighted(succ)
    wide = own.filter("id != succ").groupBy(F.col("succ").alias("of")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > degree)
    top = own.agg(F.max("id").alias("top"))
    hot = wide.select(F.col("of").alias("succ"), F.lit(True).alias("hot"))
    salted = own.join(hot, "succ", "left").withColumn("hot", F.coalesce("hot", F.lit(False)) & (F.col("id") != F.col("succ"))).crossJoin(F.broadcast(top))
    place = F.col("top") + 1 + F.col("succ") * fan + F.pmod(F.xxhash64("id"), F.lit(fan))
    moved = salted.select("id", F.when(F.col("hot"), place).otherwise(F.col("succ")).alias("succ"), "weight", "hot", F.col("succ").alias("of"))
    proxies = moved.filter("hot").select(F.col("succ").alias("id"), "of").distinct()
    return moved.select("id", "succ", "weight").unionByName(proxies.select("id", F.col("of").alias("succ"), F.lit(0).cast("long").alias("weight"))), proxies


def euler_tour(succ: DataFrame, proxies: DataFrame | None = None) -> DataFrame:
    """(id, succ, weight, is_up, v, u): a list for each tree, of its edges in both directions.

    After the step from a to v comes the step from v to the neighbour that follows a in order of id, on a circle;
    at a root the circle is cut behind the last one, and the root's end element follows. Up weighs 1, down -1 and
    steps from and to proxies 0, so an up-step's distance to the end is its vertex's depth.
    """
    up = succ.filter("id != succ").select("id", "succ")
    near = up.select(F.col("succ").alias("v"), F.col("id").alias("u"), F.lit(False).alias("u_above")).unionByName(up.select(F.col("id").alias("v"), F.col("succ").alias("u"), F.lit(True).alias("u_above")))
    order = Window.partitionBy("v").orderBy("u")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    it = F.struct("u", "u_above")
    turns = near.withColumn("next", F.lead(it).over(order)).withColumn("first", F.first(it).over(whole)).withColumn("inner", F.max(F.col("u_above").cast("int")).over(whole))
    step = F.coalesce("next", F.when(F.col("inner") == 1, F.col("first")))
    element = F.when(F.col("u_above"), 2 * F.col("v") + 1).otherwise(2 * F.col("u"))
    after = F.when(step.isNull() | step["u_above"], 2 * F.col("v")).otherwise(2 * step["u"] + 1)
    down, weight = F.col("u_above"), F.when(F.col("u_above"), -1).otherwise(1).cast("long")
    tour = turns.select(element.alias("id"), after.alias("succ"), weight.alias("weight"), (~down).alias("is_up"), F.col("u").alias("v"), F.col("v").alias("u"))
    if proxies is not None:
        zero = proxies.select(F.when(F.lit(True), F.array(2 * F.col("id"), 2 * F.col("id") + 1)).alias("ids")).select(F.explode("ids").alias("id"), F.lit(True).alias("still"))
        tour = tour.join(zero, "id", "left").withColumn("weight", F.when(F.col("still"), 0).otherwise(F.col("weight")).cast("long")).drop("still")
    end, none = 2 * F.col("id"), F.lit(0).cast("long")
    ends = succ.filter("id = succ").select(end.alias("id"), end.alias("succ"), none.alias("weight"), F.lit(False).alias("is_up"), F.col("id").alias("v"), F.col("id").alias("u"))
    return tour.unionByName(ends)


def from_tour(ranked: DataFrame, tour: DataFrame, succ: DataFrame, proxies: DataFrame | None = None) -> DataFrame:
    """(id, root, rank) of the forest's vertices from the ranked tour."""
    steps = tour.filter("is_up").select("id", "v").join(ranked.hint("merge"), "id").select(F.col("v").alias("id"), F.expr("root div 2").alias("root"), "rank")
    steps = steps if proxies is None else steps.join(proxies.select("id"), "id", "left_anti")
    return steps.unionByName(succ.filter("id = succ").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("rank")))


#: Children of a vertex from which it gets proxies without being asked.
HOT = 10_000


def euler_rank(succ: DataFrame, degree: int | None = None, rank: Callable[[DataFrame], DataFrame] = doubling) -> DataFrame:
    """(id, root, rank): depths of a forest's vertices, over its Euler tour and any ranking of lists.

    degree resolves vertices with more children into proxies first; without it, vertices with more than HOT, into as
    many proxies as the square root of the most children.
    """
    own, proxies = keep(weighted(succ)), None
    if degree is not None:
        own, proxies = with_proxies(own, degree)
    elif (most := own.filter("id != succ").groupBy("succ").count().agg(F.max("count")).first()[0] or 0) > HOT:
        own, proxies = with_proxies(own, HOT, math.isqrt(most))
    if proxies is not None:
        own, proxies = keep(own), keep(proxies)
    tour = keep(euler_tour(own, proxies))
    return from_tour(rank(tour.select("id", "succ", "weight")), tour, own, proxies)


def tour_positions(succ: DataFrame) -> DataFrame:
    """(id, root, rank) of the tour's elements under unit weights: how many steps are left."""
    return doubling(keep(euler_tour(succ)).select("id", "succ"))


def tour_edges(tour: DataFrame) -> DataFrame:
    """(id, v, u, next_v, next_u): each step and the one after it."""
    nxt = tour.select(F.col("id").alias("succ"), F.col("v").alias("next_v"), F.col("u").alias("next_u"))
    return tour.select("id", "succ", "v", "u").join(nxt, "succ").select("id", "v", "u", "next_v", "next_u")
