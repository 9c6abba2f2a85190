"""What several text operators share: kept tables, joins with small tables, samples and text helpers."""

from __future__ import annotations

import ctypes
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import keep as stash
from ..plans.tables import release as unstash

__all__ = ["WORD", "attach", "hash_sample", "held_out", "lower_ascii", "repeat", "stash", "tidy", "unstash"]

#: The words everywhere in this package: what the separators leave.
WORD = r"[^\x20\x09-\x0D]+"


def tidy() -> None:
    """Gives memory that a process has freed back to the machine: workers live on, and share an executor's limit with its JVM, as the driver does."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim is not None:
        trim(0)


def attach(rows: DataFrame, table: DataFrame, keys: list[str], most_rows: int = 100_000, salts: int = 64) -> DataFrame:
    """Left-joins a small table to rows whose keys may be very uneven; null keys match.

    The table is counted first: up to most_rows it is broadcast; beyond, each of its rows is repeated for every
    salt and the rows are dealt by key and salt, so that no key lands in one task.
    """
    table = table.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in table.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    if table.limit(most_rows + 1).count() <= most_rows:
        return rows.join(F.broadcast(table), on, "left").drop(*(f"__{k}" for k in keys))
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    right = table.withColumn("__salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [*on, left["__salt"] == right["__salt_"]], "left").drop("__salt", "__salt_", *(f"__{k}" for k in keys))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Where a text has nothing else, lower does the same and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def repeat(rows: DataFrame, n: Column, at_once: int = 1 << 16) -> DataFrame:
    """Every row n times, with copy from 1 on; no array has more than at_once or n / at_once places."""
    parts = rows.withColumn("__n", n.cast("long")).withColumn("__part", F.explode(F.expr(f"sequence(0L, (__n - 1) div {at_once}L)")))
    size = F.least(F.lit(at_once).cast("long"), F.col("__n") - F.col("__part") * at_once)
    copies = parts.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), size)))
    return copies.withColumn("copy", F.col("copy") + F.col("__part") * at_once).drop("__n", "__part")


def held_out(doc_id: Column | str, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves the remainder part; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit(""))), F.lit(parts)) == part


def hash_sample(rows: DataFrame, n: int, sample: int) -> DataFrame:
    """Of n rows with a 64-bit hash h about sample, and at most sample plus a third: a share of the hash's range."""
    share = min(1.0, sample / max(1, n))
    return rows.filter(F.pmod("h", F.lit(1_000_000_007)) < int(share * 1_000_000_007)).limit(sample + sample // 3)
