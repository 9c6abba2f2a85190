"""Graphs as edge tables (src, dst, weight): accessors, breadth-first search, forests out of graphs."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import dealt, keep, keep_by, release
from .components import components
from .lookups import FEW


#: Tables of levels beside each other, at least, before two become one.
MANY = 16


def both_directions(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return edges.unionByName(back)


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, degree); vertices adds those without an edge."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return out if vertices is None else vertices.join(out, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, neighbours): sorted adjacency, where order matters; an array holds one vertex's edges."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def counts(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return vertices.agg(F.count(F.lit(1)).alias("num_vertices")).crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("num_edges"))))


def edges_to_succ(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, succ): the largest neighbour, or the vertex itself if it has none. May hold cycles."""
    last = edges.groupBy(F.col("src").alias("id")).agg(F.max("dst").alias("to"))
    return vertices.join(last, "id", "left").select("id", F.coalesce("to", "id").alias("succ"))


def bfs(edges: DataFrame, starts: DataFrame, edge_pred: Column | None = None, max_levels: int | None = None, on_level: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """(id, parent, level) of all vertices that starts (id) reach, level by level; of several parents the least.

    edge_pred, over src, dst and weight, says which edges may be used. on_level sees each level's number and
    vertices, the starts included. A level is a join of its vertices with the edges, one aggregation and an anti-join
    with what is visited; the number of levels is the number of rounds. Levels are put together two by two as they
    grow, so what is visited is as many tables as the logarithm of the levels, and each row is rewritten as often.
    """
    edges = edges if edge_pred is None else edges.filter(edge_pred)
    now, level = keep(starts.select("id", F.col("id").alias("parent"), F.lit(0).cast("long").alias("level")).distinct()), 0
    visited: list[tuple[int, DataFrame]] = []
    while n := now.count():
        if on_level is not None:
            on_level(level, now)
        if max_levels is not None and level >= max_levels:
            visited.append((n, now))
            break
        level += 1
        seen = reduce(DataFrame.unionByName, [x.select("id") for _, x in visited], now.select("id"))
        front = now.select(F.col("id").alias("src"))
        found = edges.join(F.broadcast(front) if n <= FEW else front.hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        new = keep(found.join(seen.hint("merge"), "id", "left_anti").select("id", "parent", F.lit(level).cast("long").alias("level")))
        visited.append((n, now))
        while len(visited) > MANY and visited[-2][0] <= 2 * visited[-1][0]:
            (few, a), (more, b) = visited.pop(), visited.pop()
            visited.append((few + more, keep(a.unionByName(b))))
            release(a)
            release(b)
        now = new
    return reduce(DataFrame.unionByName, [x for _, x in visited], now.limit(0)) if visited else now


def _contract(edges: DataFrame, many: int) -> tuple[DataFrame, DataFrame]:
    """(moved, less): each vertex becomes the least of itself and what its edges lead to. moved (id) are those that
    become another; less (src, dst) are the edges between what is left, each once.

    An edge from a vertex to what it becomes stays an edge or ends in one vertex, so what hung together still does, and
    the least vertex of a component stays itself.
    """
    least = keep(edges.groupBy("src").agg(F.min("dst").alias("to")).filter("to < src"))
    to = dealt(least.select(F.col("src").alias("dst"), F.col("to").alias("end")), many, "dst").hint("shuffle_hash")
    one = edges.join(least.hint("shuffle_hash"), "src", "left").select(F.coalesce("to", "src").alias("begin"), "dst")
    both = dealt(one, many, "dst").join(to, "dst", "left").select("begin", F.coalesce("end", "dst").alias("end")).filter("begin != end")
    less = both.select(F.greatest("begin", "end").alias("src"), F.least("begin", "end").alias("dst"))
    return least.select(F.col("src").alias("id")), keep(dealt(less, many, "src", "dst").distinct())


#: Edges, at least, that are contracted before components are sought, and rounds of that, at most.
MANY_EDGES, ROUNDS = 1 << 20, 4


def starts_of(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id): the least vertex of every component. Many edges are contracted first, for as long as that makes them half."""
    moved, now, many = [], edges, edges.count()
    for _ in range(ROUNDS):
        if many <= MANY_EDGES:
            break
        gone, less = _contract(now, many) if now is edges else _contract(both_directions(now), 2 * many)
        if now is not edges:
            release(now)
        moved.append(gone)
        before, now, many = many, less, less.count()
        if len(moved) > 1 and many > before / 2:
            break
    roots = components(now.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return vertices.join(reduce(DataFrame.unionByName, moved, roots.select(F.col("u").alias("id"))).hint("merge"), "id", "left_anti")


def bfs_forest(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, succ): breadth-first trees from the least vertex of every component, all at once; lone vertices are roots.

    The edges are kept by their src: levels and the first contraction don't shuffle them.
    """
    edges = keep_by(edges.select("src", "dst"), "src")
    out = bfs(edges, starts_of(edges, vertices)).select("id", F.col("parent").alias("succ"))
    release(edges)
    return out


def lightest_edge_forest(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, succ): every vertex points along its lightest edge (ties: least neighbour); of two that point at each other the smaller is a root.

    Weight and neighbour, which is not negative, are one number of 38 digits, so that the least is found by a hash
    table of the vertices; with a structure Spark sorts the edges first.
    """
    wide, base = "decimal(38,0)", F.lit(Decimal(1 << 63)).cast("decimal(19,0)")
    both = (F.col("weight").cast("long").cast("decimal(19,0)") * base).cast(wide) + F.col("dst").cast("decimal(19,0)")
    least = edges.groupBy(F.col("src").alias("id")).agg(F.min(both.cast(wide)).alias("e"))
    pick = keep(least.select("id", F.pmod(F.col("e"), base.cast(wide)).cast("long").alias("to")))
    own = vertices.join(pick, "id", "left")
    back = pick.select(F.col("id").alias("to"), F.col("to").alias("back"))
    mutual = (F.col("back") == F.col("id")) & (F.col("id") < F.col("to"))
    return own.join(back, "to", "left").select("id", F.when(F.col("to").isNull() | F.coalesce(mutual, F.lit(False)), F.col("id")).otherwise(F.col("to")).alias("succ"))
