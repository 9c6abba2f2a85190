"""Exact deduplication by skew-safe combining.

Rows with equal text are found in three steps that each compare full content: rows are combined where they are
read (the map side of the first aggregation), the local winners are merged by digest and salt, and the salt winners
are combined over all salts. A group of copies, however large, reaches the exchanges as one row per task and salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, repeat, stash

SALTS = 32  # bits of an int mask


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("content"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("content", 256)))
    return rows.withColumn("digest", digest(F.col("sha"))).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = lambda sha: sha) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z only; null counts as empty, so all null and empty texts are
    one group. The row with the largest id stays. Null ids lose to any other; in a group with null ids only, keep_id
    is null and one row stays. Of repeated rows (same id, same text) exactly one stays. An empty table gives an
    empty result. Other columns are not read.

    digest derives the grouping digest from the SHA-256; texts that share a digest are told apart by content.
    """
    keyed = _keyed(docs, id_col, text_col, digest)
    salted = keyed.groupBy("digest", "salt", "content").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "content").agg(
        F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt"))).alias("salts")
    )
    winners = stash(merged.drop("content"))
    clashes = winners.groupBy("digest").count().filter("count > 1").select("digest")
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.col("salts").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    rows = keyed.groupBy("digest", "salt", "id", "sha").agg(F.count(F.lit(1)).alias("n"))
    if clashes.isEmpty():
        found = rows.join(winners.select("digest", F.explode(salts).alias("salt"), "keep_id", "group_size"), ["digest", "salt"])
    else:  # different texts share a digest: there the content itself is the key
        clashes = stash(clashes)
        plain = winners.join(clashes, "digest", "left_anti").select("digest", F.explode(salts).alias("salt"), "keep_id", "group_size")
        found = rows.join(plain, ["digest", "salt"]).select("id", "sha", "n", "keep_id", "group_size")
        full = keyed.join(clashes, "digest", "left_semi").groupBy("digest", "content", "salt", "id", "sha").agg(F.count(F.lit(1)).alias("n"))
        wide = merged.join(clashes, "digest", "left_semi").select("digest", "content", F.explode(salts).alias("salt"), "keep_id", "group_size")
        found = found.unionByName(full.join(wide, ["digest", "content", "salt"]).select("id", "sha", "n", "keep_id", "group_size"))
    return repeat(found, F.col("n")).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of repeated rows (same id, same text) any one.

    Null and empty texts are one group, of which one row stays; a null id loses to any other; an empty table gives an
    empty result.
    """
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("__id"), F.unhex("text_sha256").alias("__sha"))
    rows = docs.withColumn("__own", F.unhex(F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256)))
    joined = rows.join(kept, rows[id_col].eqNullSafe(kept["__id"]) & (rows["__own"] == kept["__sha"]))
    return joined.dropDuplicates(["__id", "__sha"]).select(*docs.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_dedup of documents; see there for nulls, empty texts, ties and repeated rows."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op3_exact_dedup": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id AS doc_id, g.keep_id AS keep_id, g.group_size AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
}
QUERIES = {"op3_exact_dedup": op3_exact_dedup}
