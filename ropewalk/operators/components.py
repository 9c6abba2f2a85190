"""Connected components by alternating large and small stars (Kiveris et al. 2014), all on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import keep, release


#: Edges of a vertex that make it a hub, at least; and hubs, at most.
LEAST_HUB, MOST_HUBS = 16, 10_000


def _with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """rows (u, v) with m, from least (u, m, n): the rows of a hub meet its least where they lie, all others by a shuffle.

    A hub has so many of the edges that there are MOST_HUBS of them at most, which bounds the broadcast.
    """
    bound = max(LEAST_HUB, 4 * edges // MOST_HUBS)
    hubs = least.filter(F.col("n") > bound).select("u", F.col("m").alias("hub"))
    marked = rows.join(F.broadcast(hubs), "u", "left")
    rest = marked.filter("hub is null").select("u", "v").join(least.filter(F.col("n") <= bound).select("u", "m"), "u")
    return marked.filter("hub is not null").select("u", "v", F.col("hub").alias("m")).unionByName(rest)


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.filter("v > u"), least, 2 * count).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    rows = _with_least(down, least, count).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rows.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Of edges (u, v): (u, v) for each vertex u but the least of its component, v that least one.

    Rounds go on until one changes nothing; their number grows with the logarithm of the longest chain. Each round is
    written to the shared folder and the one before removed.
    """
    now = keep(edges.filter("u != v").distinct())
    mark, count = None, now.count()
    while True:
        new = keep(_small_star(_large_star(now, count), count))
        release(now)
        now = new
        then, mark = mark, now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if mark == then or mark[0] == 0:
            return now
        count = mark[0]
