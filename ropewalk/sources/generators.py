"""Generated lists, forests and graphs: expressions over spark.range, the same at every run."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.forest import euler_tour
from ..operators.graphs import bfs_forest, both_directions, edges_to_succ
from ..operators.lookups import dense_ids
from ..plans.tables import keep
from .tables import keyed_path


def _ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumn("n", F.lit(n).cast("long"))


def _uniform(seed: int, *columns: str | Column) -> Column:
    """In [0, 1), by hash."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def _coprime(n: int) -> int:
    """A factor, near the golden ratio of n, by which places are mixed one to one."""
    return next(s for s in range(int(n * 0.61803) | 1, 2 * n + 3) if math.gcd(s, n) == 1) if n > 1 else 1


def path(spark: SparkSession, n: int, permute: bool = False, permutation_prob: float = 1.0, p: float = 1.0, seed: int = 1) -> DataFrame:
    """(id, succ): a list of n elements; permute mixes a share of the ids among themselves; each step is there with probability p."""
    ids = _ids(spark, n)
    place = F.col("id")
    if permute:
        slots = keep(dense_ids(ids.filter(_uniform(seed, "id") < permutation_prob).select("id")))
        m = slots.count()
        other = slots.select(F.col("id").alias("place"), F.col("dense").alias("to"))
        moved = slots.withColumn("to", (F.col("dense") * _coprime(m) + seed) % max(1, m)).join(other, "to").select("id", "place")
        ids = ids.join(moved, "id", "left").withColumn("place", F.coalesce("place", "id"))
        place = F.col("place")
    out = keyed_path(ids, place)
    return out if p >= 1 else out.select("id", F.when(_uniform(seed + 2, "id") < p, F.col("succ")).otherwise(F.col("id")).alias("succ"))


def star(ids: DataFrame) -> DataFrame:
    return ids.select("id", F.lit(0).cast("long").alias("succ"))


def tailed_star(ids: DataFrame) -> DataFrame:
    """The first half of the ids is a path to 0, the rest hang on its far end."""
    half = F.floor(F.col("n") / 2)
    return ids.select("id", F.when(F.col("id") == 0, 0).when(F.col("id") < half, F.col("id") - 1).otherwise(F.greatest(half - 1, F.lit(0))).cast("long").alias("succ"))


def caterpillar(ids: DataFrame, legs: int = 1) -> DataFrame:
    """A path of every (legs + 1)-th id to 0, each with legs behind it."""
    step = legs + 1
    return ids.select("id", F.when(F.col("id") == 0, 0).when(F.col("id") % step == 0, F.col("id") - step).otherwise(F.col("id") - F.col("id") % step).cast("long").alias("succ"))


def stars(ids: DataFrame, roots: int) -> DataFrame:
    return ids.select("id", (F.col("id") % roots).cast("long").alias("succ"))


def random_tree(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Each element below an earlier one, by hash."""
    return spark.range(n).select("id", F.when(F.col("id") > 0, F.pmod(F.xxhash64("id", F.lit(seed)), F.greatest("id", F.lit(1)))).otherwise(0).cast("long").alias("succ"))


def relabelled(succ: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """The same structure under other ids 0 to n - 1: a step coprime to n, and an offset."""
    step = _coprime(n)
    place = lambda c: (F.col(c) * step + seed) % n
    return succ.select(place("id").alias("id"), place("succ").alias("succ"), *[c for c in succ.columns if c not in ("id", "succ")])


def gnm(spark: SparkSession, n: int, m: int, seed: int = 1) -> DataFrame:
    """(src, dst, weight) both ways: about m undirected random edges (pairs drawn twice count once)."""
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(n))
    return _edges(spark.range(m).select(draw(1).alias("a"), draw(2).alias("b")), seed)


def rmat(spark: SparkSession, scale: int, m: int, a: float = 0.57, b: float = 0.19, c: float = 0.19, seed: int = 1) -> DataFrame:
    """Edges of a recursive-matrix graph on 2^scale vertices."""
    x = y = F.lit(0).cast("long")
    for k in range(scale):
        u = _uniform(seed + 7 * k, "id")
        x, y = x * 2 + (u >= a + b).cast("long"), y * 2 + (((u >= a) & (u < a + b)) | (u >= a + b + c)).cast("long")
    return _edges(spark.range(m).select(x.alias("a"), y.alias("b")), seed)


def rgg2d(spark: SparkSession, n: int, radius: float, seed: int = 1) -> DataFrame:
    """Edges between random points of the unit square nearer than radius: each cell is joined with it and its eight neighbours."""
    points = spark.range(n).select("id", _uniform(seed, "id").alias("x"), _uniform(seed + 1, "id").alias("y"))
    cells = points.withColumn("cx", F.floor(F.col("x") / radius)).withColumn("cy", F.floor(F.col("y") / radius))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    other = cells.select(F.col("id").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy", around.alias("d")).select("b", "x2", "y2", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))
    near = cells.join(other, ["cx", "cy"]).filter((F.col("id") < F.col("b")) & (F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2) < radius * radius))
    return _edges(near.select(F.col("id").alias("a"), "b"), seed)


def _edges(pairs: DataFrame, seed: int) -> DataFrame:
    own = pairs.filter("a != b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    return both_directions(own.withColumn("weight", F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1 << 20))))


def from_spec(spark: SparkSession, spec: str, processing: str = "none") -> DataFrame:
    """(id, succ[, weight]) from an option string such as "type=path;n=1000;permute=true".

    Types: path, star, tailed-star, caterpillar, stars, random-tree, gnm-undirected, rmat, rgg2d. processing says
    what becomes of a graph: none (last neighbour), bfs (breadth-first forest), eulertour (its tour as a list), and
    eulertour-break-high-degree.
    """
    from ..operators.forest import with_proxies

    o = dict(x.split("=", 1) for x in spec.split(";") if "=" in x) | {x: "true" for x in spec.split(";") if x and "=" not in x}
    n, seed, kind = int(o.get("n", 1 << int(o.get("N", 10)))), int(o.get("seed", 1)), o["type"]
    if kind == "path":
        return path(spark, n, o.get("permute", "false") == "true", float(o.get("permutation_prob", 1)), float(o.get("p", 1)), seed)
    ids = _ids(spark, n)
    trees = {
        "star": lambda: star(ids),
        "tailed-star": lambda: tailed_star(ids),
        "caterpillar": lambda: caterpillar(ids, int(o.get("legs", 1))),
        "stars": lambda: stars(ids, int(o.get("roots", 10))),
        "random-tree": lambda: random_tree(spark, n, seed),
    }
    if kind in trees:
        forest = trees[kind]()
    else:
        m = int(o.get("m", 4 * n))
        graphs = {
            "gnm-undirected": lambda: gnm(spark, n, m, seed),
            "rmat": lambda: rmat(spark, max(1, (n - 1).bit_length()), m, seed=seed),
            "rgg2d": lambda: rgg2d(spark, n, float(o.get("r", 2 / math.sqrt(max(4, n)))), seed),
        }
        edges, vertices = graphs[kind](), spark.range(1 << max(1, (n - 1).bit_length()) if kind == "rmat" else n)
        if processing == "none":
            return edges_to_succ(edges, vertices)
        forest = bfs_forest(edges, vertices)
    if processing == "eulertour":
        return euler_tour(forest).select("id", "succ")
    if processing == "eulertour-break-high-degree":
        own, proxies = with_proxies(forest)
        return euler_tour(own, proxies).select("id", "succ")
    return forest
