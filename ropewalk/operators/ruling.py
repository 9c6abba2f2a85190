"""Sparse ruling sets: walks from sampled elements, ranking of those alone, and propagation to the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ruler_rate
from ..plans.fixpoint import Metrics
from ..plans.tables import dealt, keep, release
from ..schema import StructureError, weighted
from .doubling import doubling
from .gather import contracted
from .lookups import meet
from .predicates import is_list, leaves, reverse_list


def hash_rule(every: int, seed: int = 42) -> Column:
    """One element in every, chosen by hash: any retry of a task chooses the same."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(every)) == 0


def rulers(succ: DataFrame, rule: Column, heads: bool = True, rows: int = 0) -> DataFrame:
    """Sampled elements but roots, and the heads of lists, without which their beginnings are never reached."""
    own = succ.filter(rule & (F.col("id") != F.col("succ"))).select("id")
    return own.unionByName(leaves(succ, proper_only=True, rows=rows)).distinct() if heads else own


def walk(succ: DataFrame, chosen: DataFrame, rounds: int | None, metrics: Metrics | None = None) -> tuple[DataFrame, DataFrame]:
    """Walks on from each ruler along the list for some rounds: (reached, links).

    reached: (id, ruler, dist) for elements passed. links: (id, succ, weight) from each ruler to the ruler or root that
    ended its walk, or to where it stands when the rounds are over. Without rounds all walk to their ends.
    """
    metrics = metrics if metrics is not None else Metrics()
    own = keep(weighted(succ))
    n = own.count()
    nodes = keep(dealt(own, n, "id").join(dealt(chosen, n, "id").withColumn("stop", F.lit(True)).hint("merge"), "id", "left").withColumn("stop", F.coalesce("stop", F.lit(False)) | (F.col("id") == F.col("succ"))))
    release(own)
    front, going = dealt(nodes, n, "id").join(dealt(chosen, n, "id").hint("merge"), "id").filter("id != succ").select(F.col("succ").alias("target"), F.col("id").alias("ruler"), F.col("weight").alias("dist")), chosen.count()
    reached, links = [], []
    for _ in range(max(1, n) if rounds is None else rounds):
        now = keep(meet(front, nodes.withColumnRenamed("id", "target"), "target", going, of=n), "stop")
        links.append(now.filter("stop").select(F.col("ruler").alias("id"), F.col("target").alias("succ"), F.col("dist").alias("weight")))
        on = now.filter("not stop")
        reached.append(on.select(F.col("target").alias("id"), "ruler", "dist"))
        front = on.select(F.col("succ").alias("target"), "ruler", (F.col("dist") + F.col("weight")).alias("dist"))
        going = on.count()
        metrics.active.append(going)
        if not metrics.active[-1]:
            break
    links.append(front.select(F.col("ruler").alias("id"), F.col("target").alias("succ"), F.col("dist").alias("weight")))
    out, link = reached[0], links[0]
    for r in reached[1:]:
        out = out.unionByName(r)
    for x in links[1:]:
        link = link.unionByName(x)
    return out, link


def unreached(succ: DataFrame, chosen: DataFrame, reached: DataFrame, rows: int = 0) -> DataFrame:
    """Elements, no roots, that no walk passed and that are no rulers."""
    passed = dealt(reached.select("id").unionByName(chosen), rows, "id")
    return dealt(succ.filter("id != succ").select("id"), rows, "id").join(passed.hint("merge"), "id", "left_anti")


def walk_stats(succ: DataFrame, chosen: DataFrame, rounds: int | None) -> DataFrame:
    """One row: num_rulers, num_leaves, num_reached, num_unreached, small (what is left to rank) and rounds of walks."""
    metrics, own = Metrics(), weighted(succ)
    reached, _ = walk(own, chosen, rounds, metrics)
    heads = leaves(own, proper_only=True)
    counts = [(chosen, "num_rulers"), (heads, "num_leaves"), (reached, "num_reached"), (unreached(own, chosen, reached), "num_unreached"), (own.filter("id = succ"), "roots")]
    out = None
    for df, name in counts:
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    small = (F.col("num_rulers") + F.col("num_unreached") + F.col("roots")).alias("small")
    return out.select("num_rulers", "num_leaves", "num_reached", "num_unreached", small, F.lit(metrics.rounds).cast("long").alias("rounds"))


def ruling_set(
    succ: DataFrame,
    every: int = 4,
    rounds: int = 6,
    levels: int = 1,
    rule: Column | None = None,
    base: Callable[[DataFrame], DataFrame] = doubling,
    block_rows: int | None = None,
    ruler: str | None = None,
    factor: float = 1.0,
    metrics: Metrics | None = None,
) -> DataFrame:
    """(id, root, rank) of lists.

    Rulers' walks are cut off after some rounds; what they have not reached joins the rulers' list, so the number of
    rounds is fixed and nothing is lost. That list is ranked by another level, or by base. block_rows contracts what
    lies inside ranges of about so many ids first; the walks then go between ranges only. ruler names a formula for
    the number of rulers (see functions.scalars.ruler_rate), which factor scales, instead of one in every.
    """
    if block_rows is not None:
        return contracted(succ, block_rows, base=lambda x: ruling_set(x, every, rounds, levels, rule, base, None, ruler, factor, metrics), metrics=metrics)
    if ruler is not None:
        rule = rate_rule(ruler, succ.count(), succ.sparkSession.sparkContext.defaultParallelism, factor)
    if not is_list(succ):
        raise StructureError("a ruling set needs lists: an element has two predecessors")
    own = weighted(succ)
    n = own.count()
    chosen = keep(rulers(own, rule if rule is not None else hash_rule(every), rows=n))
    reached, links = walk(own, chosen, rounds, metrics)
    rest = dealt(own, n, "id").join(unreached(own, chosen, reached, n).hint("merge"), "id")
    small = keep(links.unionByName(rest).unionByName(own.filter("id = succ")))
    if metrics is not None:
        metrics.more.update(rulers=chosen.count(), small=small.count())
    ranked = keep(ruling_set(small, every, rounds, levels - 1, hash_rule(every, levels), base) if levels > 1 else base(small))
    passed = dealt(reached, n, "ruler").join(dealt(ranked.withColumnRenamed("id", "ruler"), n, "ruler").hint("merge"), "ruler")
    return ranked.unionByName(passed.select("id", "root", (F.col("rank") - F.col("dist")).alias("rank")))


def post_invert(ranked: DataFrame) -> DataFrame:
    """From distances to the head of each list to distances to its tail, which becomes the root.

    One aggregation by list and one join; the aggregate has a row for each list.
    """
    ends = ranked.groupBy(F.col("root").alias("head")).agg(F.max(F.struct("rank", "id")).alias("tail"))
    return ranked.withColumnRenamed("root", "head").join(ends, "head").select("id", F.col("tail.id").alias("root"), (F.col("tail.rank") - F.col("rank")).alias("rank"))


def ruling_set_inverted(succ: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """Ranks the reversed list and turns the ranks round. Weights must be positive, or the tail isn't the farthest."""
    return post_invert(ruling_set(reverse_list(succ), **options))


def forest_ruling_set(succ: DataFrame, every: int = 4, rounds: int = 4, levels: int = 1, rule: Column | None = None, base: Callable[[DataFrame], DataFrame] = doubling) -> DataFrame:
    """(id, root, rank) of forests: walks go down from roots and rulers to all children at once.

    Each element has one parent, so it is reached once, by the nearest ruler above it. The rulers' forest is ranked by
    another level, or by base.
    """
    own = weighted(succ)
    stops = own.withColumn("stop", (F.col("id") == F.col("succ")) | (rule if rule is not None else hash_rule(every)))
    nodes = keep(stops)
    children = nodes.filter("id != succ").select(F.col("succ").alias("above"), "id", "weight", "stop")
    front = nodes.filter("stop").select(F.col("id").alias("above"), F.col("id").alias("ruler"), F.lit(0).cast("long").alias("dist"))
    found = []
    for _ in range(rounds):
        now = keep(front.join(children, "above").select("id", "ruler", (F.col("dist") + F.col("weight")).alias("dist"), "stop"), "stop")
        found.append(now)
        front = now.filter("not stop").select(F.col("id").alias("above"), "ruler", "dist")
        if not now.filter("not stop").count():
            break
    reached = found[0]
    for x in found[1:]:
        reached = reached.unionByName(x)
    links = reached.filter("stop").select("id", F.col("ruler").alias("succ"), F.col("dist").alias("weight"))
    last = front.select(F.col("above").alias("id"), F.col("ruler").alias("succ"), F.col("dist").alias("weight"))
    rest = nodes.filter("id != succ").join(reached.select("id"), "id", "left_anti").select("id", "succ", "weight")
    small = links.unionByName(last).unionByName(rest).unionByName(own.filter("id = succ"))
    small = keep(small)
    ranked = keep(forest_ruling_set(small, every, rounds, levels - 1, hash_rule(every, levels), base) if levels > 1 else base(small))
    passed = reached.filter("not stop").join(last.select("id"), "id", "left_anti")
    return ranked.unionByName(passed.join(ranked.withColumnRenamed("id", "ruler"), "ruler").select("id", "root", (F.col("rank") + F.col("dist")).alias("rank")))


def chain_stats(reached: DataFrame, links: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: num_rulers, num_links, min_segment, max_segment, avg_segment in elements, from ruler to ruler."""
    segments = links.select("id").join(reached.groupBy(F.col("ruler").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left").select((F.coalesce("n", F.lit(0)) + 1).alias("n"))
    return segments.agg(F.count(F.lit(1)).alias("num_links"), F.min("n").alias("min_segment"), F.max("n").alias("max_segment"), F.avg("n").alias("avg_segment")).crossJoin(F.broadcast(chosen.agg(F.count(F.lit(1)).alias("num_rulers"))))


def rate_rule(strategy: str, n: int, p: int, factor: float = 1.0, seed: int = 42) -> Column:
    """Sampling by one of the named formulas for the number of rulers."""
    share = ruler_rate(strategy, n, p, factor)
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
