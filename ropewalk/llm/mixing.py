"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Every document has a key: a hash of its id, where ids agree a hash of its text, and where both agree its place in
the table that holds the keys. A source takes all its documents as often as its target covers them in full, and once
more those whose key is below a threshold. The threshold comes from histograms of words over buckets of keys: the
bucket in which the remaining budget ends is split again, 12 bits at a time, until it holds one document. Nothing is
sorted but the buckets of a source, 4096 at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, attach, stash, unstash

BITS = 12
#: A key's parts, most significant first, and its digits: part and place of the lowest bit.
PARTS = ("h", "g", "row")
DIGITS = [(part, at) for part, top in zip(PARTS, (48, 48, 60), strict=True) for at in range(top, -1, -BITS)]
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _hash(text: Column) -> Column:
    """60 bits of the MD5; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _key(docs: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    """The parts of each row's key. The last one is fixed when the rows are written."""
    return dict(zip(PARTS, (_hash(F.col(id_col).cast("string")), _hash(F.col(text_col)), F.monotonically_increasing_id()), strict=True))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target, whole, rest: of (source, size) rows.

    Sources by code point, null last, get the weights in turn and share all words by weight; where a share passes
    most times the source's size it stops there, and the excess goes to the others by weight. That is one water level:
    target = least(most * size, level * weight). The level is found on the sources in order of most * size / weight.
    whole repeats of a source fit into its target, rest words remain.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by = by.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    by = by.withColumn("most", F.col("source_size") * most)
    line = Window.orderBy(F.col("most").cast("double") / F.col("weight"), "place")
    before = F.coalesce(F.sum("most").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("level", (F.sum("source_size").over(everything) - before).cast("double") / left).withColumn("at", F.row_number().over(line))
    fits = F.col("level") * F.col("weight") <= F.col("most")
    by = by.withColumn("level", F.min_by("level", F.when(fits, F.col("at"))).over(everything))
    by = by.withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")))
    by = by.withColumn("whole", F.when(F.col("source_size") == 0, 0).otherwise(F.least(F.lit(most), F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))).cast("long"))
    rest = F.when((F.col("source_size") == 0) | (F.col("whole") >= most), 0.0).otherwise(F.col("target") - F.col("whole") * F.col("source_size"))
    return by.select("source", "source_size", "target", "whole", rest.alias("rest"))


def _boundary(rows: DataFrame, digit: int) -> DataFrame:
    """Of rows (source, size, parts, rest, base): for each source the bucket, by a digit of the key, in which rest ends."""
    part, at = DIGITS[digit]
    ends = [f(p).alias(f"{name}_{p}") for p in PARTS for f, name in ((F.min, "low"), (F.max, "high"))]
    hist = rows.groupBy("source", F.shiftright(part, at).alias("bucket")).agg(F.sum("size").alias("inside"), F.first("rest").alias("rest"), F.first("base").alias("base"), *ends)
    line = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("base", F.col("base") + F.sum("inside").over(line) - F.col("inside"))
    names = [c for c in hist.columns if c not in ("source", "bucket")]
    found = hist.filter(F.col("base") + F.col("inside") >= F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", *names)).alias("b"))
    return found.select("source", *(F.col(f"b.{c}").alias(c) for c in names)).withColumn("digit", _first_difference())


def _first_difference() -> Column:
    """The first digit in which the keys of a bucket differ; null if they don't."""
    unlike = [F.when(F.shiftright(f"low_{part}", at) != F.shiftright(f"high_{part}", at), i) for i, (part, at) in enumerate(DIGITS)]
    return F.coalesce(*unlike)


def mix_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Of (source, size, h, g, row) rows: source, source_size, target, whole, edge_h, edge_g, edge_row, with_edge.

    A document is taken whole times, and once more if its key is below the edge, or at the edge and with_edge; the edge
    is null where the whole repeats use up the target. Keys are split at the first digit in which those of some
    source's boundary bucket differ, so repeated or null ids cost no rounds of their own.
    """
    plan = stash(targets(sizes, weights, most))
    spending = plan.filter("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("base"))
    rows = attach(sizes, spending, ["source"]).filter("rest is not null")
    state = stash(_boundary(rows, 0))
    while (digit := state.agg(F.min("digit")).first()[0]) is not None:
        part, at = DIGITS[digit]
        bounds = state.filter("digit is not null").select("source", "rest", "base", *(F.col(f"low_{p}").alias(f"low_{p}") for p in PARTS))
        inside = attach(sizes, bounds, ["source"])
        for p in PARTS[: PARTS.index(part)]:
            inside = inside.filter(F.col(p) == F.col(f"low_{p}"))
        if digit and DIGITS[digit - 1][0] == part:  # all have the digits above in common
            inside = inside.filter(F.shiftright(part, at + BITS) == F.shiftright(f"low_{part}", at + BITS))
        finer, old = stash(state.filter("digit is null").unionByName(_boundary(inside.filter("rest is not null"), digit))), state
        state = finer
        unstash(old)
    nearer = (F.col("base") + F.col("inside") - F.col("rest") < F.col("rest") - F.col("base")).alias("with_edge")
    edges = state.select("source", *(F.col(f"low_{p}").alias(f"edge_{p}") for p in PARTS), nearer)
    return attach(plan, edges, ["source"]).select("source", "source_size", "target", "whole", *(f"edge_{p}" for p in PARTS), "with_edge")


def _times(prefix: str = "") -> Column:
    extra = F.col("with_edge")
    for p in reversed(PARTS):
        own, edge = F.col(prefix + p), F.col(f"edge_{p}")
        extra = (own < edge) | ((own == edge) & extra)
    return F.col("whole") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, size, source_size, target, taken.

    size counts the words of the text (null: 0). Sources get targets (see targets()); taken is the size times the
    number of times that the mix takes the document, 3 at most. The choice follows a hash of the id, then one of the
    text, so reruns agree; of rows that have both in common, null ids included, as many are taken as the target
    needs, any of them. The document at the threshold is taken if that brings the source nearer to its target: the
    sum differs from the target by half that document at most, whether ids repeat or not. A null source is a source
    of its own. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *(c.alias(p) for p, c in _key(docs, id_col, text_col).items()))
    sizes = stash(rows)
    rows = attach(sizes, mix_plan(sizes.select("source", "size", *PARTS)), ["source"])
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs as the mix has them: each as often as mix takes it, in its own columns.

    Nulls, repeats and ties are mix's. Rows with an empty text have size 0 and are taken as often as others of their
    source. The rows are written once with their keys.
    """
    own = stash(docs.select("*", F.col(source_col).alias("__from"), word_count(F.col(text_col)).alias("__size"), *(c.alias(f"__{p}") for p, c in _key(docs, id_col, text_col).items())))
    plan = mix_plan(own.select(F.col("__from").alias("source"), F.col("__size").alias("size"), *(F.col(f"__{p}").alias(p) for p in PARTS)))
    rows = attach(own, plan.withColumnRenamed("source", "__from").drop("source_size", "target"), ["__from"])
    return rows.withColumn("__time", F.explode(F.array_repeat(F.lit(1), _times("__").cast("int")))).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix of documents; see there for nulls, empty texts, ties and repeated rows."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op4_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h,
           CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS g FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, 3 * source_size AS most FROM s),
v AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM w),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(most AS DOUBLE) / weight, place) AS rk FROM v),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(weight) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM o),
f AS (SELECT arg_min(level, rk) AS level FROM l WHERE level * weight <= most),
t AS (SELECT l.source, l.source_size, least(CAST(l.most AS DOUBLE), f.level * l.weight) AS target FROM l, f),
k AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(least(3, floor(target / source_size)) AS BIGINT) END AS whole FROM t),
r AS (SELECT *, CASE WHEN source_size = 0 OR whole >= 3 THEN 0 ELSE target - whole * source_size END AS rest FROM k),
c AS (SELECT d.*, r.source_size, r.target, r.whole, r.rest,
        CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.g ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS upto
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN upto - size < rest AND (upto < rest OR upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
}
QUERIES = {"op4_mixing": op4_mixing}
