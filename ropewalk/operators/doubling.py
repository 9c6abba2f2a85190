"""Pointer doubling: every element takes over its pointer's pointer until all reach a root. Lists and forests, any weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import Contraction, Metrics, round_limit, shrink
from ..plans.tables import keep, release
from ..schema import StructureError, weighted
from .chase import finish
from .lookups import FEW, ask, meet
from .predicates import init_state


#: Active elements, at most, that one task finishes; 0: rounds to the end.
TAIL = 1 << 18
#: Active elements, at most, that are no longer worth taking out (see plans.fixpoint.Contraction).
LEAST = 1 << 18


def _step(active: DataFrame, everything: DataFrame, left: int, distinct_first: bool, unit: bool, rows: int = 0) -> DataFrame:
    """An inner join, so that few active rows may be broadcast to all others; rows it loses are noticed by their count."""
    rank = F.when(F.col("done"), F.col("rank")) if unit else F.col("rank")
    replies = everything.select(F.col("id").alias("root"), F.col("root").alias("next"), rank.alias("more"), F.col("done").alias("ends"))
    found = meet(active.drop("done"), replies, "root", left, distinct_first, of=rows)
    rank = F.when(F.col("ends"), F.col("rank") + F.col("more")).otherwise(F.col("rank") * 2) if unit else F.col("rank") + F.col("more")
    return found.select("id", F.col("next").alias("root"), rank.alias("rank"), F.col("ends").alias("done"))


def _coin(element: str, level: int) -> Column:
    return F.xxhash64(element, F.lit(level)).bitwiseAND(F.lit(1)) == 1


def _shorten(active: DataFrame, level: int, rows: int, hot: bool) -> DataFrame:
    """Takes out elements of coin 0 that point at one of coin 1, a quarter, and leads what points at them past them.

    What they point at stays, so none of them waits for another. Rows that don't change are not shuffled.
    """
    own, to = _coin("id", level), _coin("root", level)
    same = active.filter(own & to)
    asking = active.filter(~to).select("id", "root", "rank")
    gone = active.filter(~own & to).select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("rank").alias("more"))
    past = meet(asking, gone, "root", rows, hot, "left")
    moved = past.select("id", F.coalesce("next", "root").alias("root"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank"), F.lit(False).alias("done"))
    return same.select("id", "root", "rank", "done").unionByName(moved)


def _expand(active: DataFrame, done: DataFrame, level: int, rows: int, hot: bool, of: int = 0) -> DataFrame:
    """The last state of the elements that a level took out: what they point at has its own by now."""
    gone = active.filter(~_coin("id", level) & _coin("root", level)).select("id", "root", "rank")
    replies = done.filter(_coin("id", level)).select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("rank").alias("more"))
    return meet(gone, replies, "root", rows, hot, of=of).select("id", F.col("next").alias("root"), (F.col("rank") + F.col("more")).alias("rank"), F.lit(True).alias("done"))


def from_state(state: DataFrame, distinct_first: bool = False, unit: bool = False, tail: int = TAIL, metrics: Metrics | None = None) -> DataFrame:
    """Of (id, root, rank, done): (id, root, rank) when all are done."""
    contracted, total = [], []

    def shorten(active: DataFrame, level: int, rows: int) -> DataFrame:
        contracted.append(level)
        return _shorten(active, level, rows, distinct_first)

    def step(active: DataFrame, everything: DataFrame, left: int) -> DataFrame:
        if not total and left > FEW:
            total.append(everything.count())
        return _step(active, everything, left, distinct_first, unit and not contracted, max(0, *total, left))

    contraction = Contraction(shorten, lambda a, d, k, n: _expand(a, d, k, n, distinct_first, max(n, *total)), least=LEAST)
    return shrink(state, step, metrics=metrics, tail=tail, finish=finish, contraction=contraction).select("id", "root", "rank")


def doubling(succ: DataFrame, distinct_first: bool = False, tail: int = TAIL, metrics: Metrics | None = None) -> DataFrame:
    """(id, root, rank). One self-join a round, about log2 of the longest path rounds; on long paths of many elements
    four of them, after which a quarter of the elements at a time is taken out and put back at the end.

    Elements that have reached their root are asked but ask no more; when tail or fewer still ask, one task finishes
    them. distinct_first sends each pointer once: a semi-join reduction that pays on trees of high degree.
    """
    return from_state(init_state(succ), distinct_first, tail=tail, metrics=metrics)


def doubling_reduced_volume(succ: DataFrame, tail: int = TAIL, metrics: Metrics | None = None) -> DataFrame:
    """For unit weights: while a pointer is short of the root its length doubles, so only last replies carry a rank."""
    return from_state(init_state(succ.select("id", "succ")), unit=True, tail=tail, metrics=metrics)


def doubling_both_ways(succ: DataFrame, metrics: Metrics | None = None) -> DataFrame:
    """For lists: each element holds the elements 2^i before and after it and tells each of the other.

    Messages instead of requests and replies: a round is a union and one aggregation by id, without a join.
    """
    metrics = metrics if metrics is not None else Metrics()
    own = weighted(succ)
    before = own.filter("id != succ").select(F.col("succ").alias("id"), F.col("id").alias("pred"))
    is_root = F.col("id") == F.col("succ")
    start = own.join(before, "id", "left").select(
        "id", F.col("succ").alias("root"), F.col("weight").alias("rank"), "pred", F.when(is_root, 0).otherwise(1).cast("long").alias("hops"), is_root.alias("done")
    )
    now, span = keep(start), 1
    limit = round_limit(now.count())
    while now.filter("not done").limit(1).count():
        if metrics.rounds > limit:
            raise StructureError("elements reach no root: the structure has a cycle")
        blank = {"root": "long", "rank": "long", "hops": "long", "done": "boolean", "to": "long", "more": "long", "steps": "long", "ends": "boolean", "back": "long"}

        def message(rows: DataFrame, target: str, **told: str) -> DataFrame:
            """A row for the element in column target that holds some columns and nothing else."""
            return rows.select(F.col(target).alias("id"), *(F.col(told[c]).alias(c) if c in told else F.lit(None).cast(t).alias(c) for c, t in blank.items()))

        mine = message(now, "id", root="root", rank="rank", hops="hops", done="done")
        forth = message(now.filter("pred is not null"), "pred", to="root", more="rank", steps="hops", ends="done")
        back = message(now.filter((F.col("hops") == span) & F.col("pred").isNotNull()), "root", back="pred")
        got = mine.unionByName(forth).unionByName(back).groupBy("id").agg(*(F.max(c).alias(c) for c in blank))
        move = ~F.col("done")
        new = keep(
            got.select(
                "id",
                F.when(move, F.col("to")).otherwise(F.col("root")).alias("root"),
                F.when(move, F.col("rank") + F.col("more")).otherwise(F.col("rank")).alias("rank"),
                F.col("back").alias("pred"),
                F.when(move, F.col("hops") + F.col("steps")).otherwise(F.col("hops")).alias("hops"),
                F.when(move, F.col("ends")).otherwise(F.col("done")).alias("done"),
            )
        )
        release(now)
        now, span = new, 2 * span
        metrics.active.append(now.filter("not done").count())
    return now.select("id", "root", "rank")


def without_high_degrees(succ: DataFrame, degree: int = 5, tail: int = TAIL) -> DataFrame:
    """Two phases: elements with degree predecessors and more become roots for a while; their own structure follows.

    The first phase has no hot pointer; the second has the few hot elements only.
    """
    own = weighted(succ)
    hot = own.filter("id != succ").groupBy("succ").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= degree).select(F.col("succ").alias("id"), F.lit(True).alias("hot"))
    marked = own.join(hot, "id", "left").withColumn("hot", F.coalesce("hot", F.lit(False)) & (F.col("id") != F.col("succ")))
    cut = marked.select("id", F.when(F.col("hot"), F.col("id")).otherwise(F.col("succ")).alias("succ"), "weight")
    first = keep(doubling(cut, tail=tail))
    links = marked.filter("hot").select("id", "succ", "weight")
    past = ask(links, first.withColumnRenamed("root", "to"), "succ")
    state = past.select("id", F.col("to").alias("root"), (F.col("weight") + F.col("rank")).alias("rank"), F.lit(False).alias("done"))
    ends = own.filter("id = succ").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("rank"), F.lit(True).alias("done"))
    second = from_state(state.unionByName(ends), tail=tail)
    below = first.select("id", F.col("root").alias("top"), F.col("rank").alias("low")).join(second.withColumnRenamed("id", "top"), "top")
    return below.select("id", "root", (F.col("low") + F.col("rank")).alias("rank"))
