"""Scalar helpers of the drivers' arithmetic and column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The names of the formulas for the number of rulers.
RULERS = ["dehne", "heuristic", "sanders", "ultimate", "ultimate-sanders", "limit-rounds"]


def ruler_rate(strategy: str, n: int, p: int, factor: float = 1.0, dims: int = 1, rounds: int = 100) -> float:
    """The share of elements that become rulers, 0 to 1.

    strategy names how their number grows with n elements on p workers: dehne n/p^2, heuristic n, sanders
    sqrt(n) p / ln n, ultimate sqrt(n) p, ultimate-sanders sqrt(n p^(1 + 1/dims)) / log2 p, limit-rounds n / rounds.
    """
    if n < 2:
        return 1.0
    wide = max(2, p)
    number = {
        "dehne": factor * n / wide**2,
        "heuristic": factor * n,
        "sanders": factor * math.sqrt(n) * p / math.log(n),
        "ultimate": factor * math.sqrt(n) * p,
        "ultimate-sanders": factor * math.sqrt(n * wide ** (1 + 1 / dims)) / math.log2(wide),
        "limit-rounds": n / rounds,
    }[strategy]
    return min(1.0, max(1 / n, number / n))


def safe_ratio(over: Column, under: Column) -> Column:
    """The quotient, 0 where the divisor is 0 or null."""
    return F.coalesce(F.try_divide(over.cast("double"), under.cast("double")), F.lit(0.0))


def ceil_div(over: Column, under: Column) -> Column:
    return F.ceil(over / under).cast("long")


def flagged(value: Column) -> Column:
    """value with its top usable bit set, as a mark of a root."""
    return value.bitwiseOR(F.lit(1 << 62))


def is_flagged(value: Column) -> Column:
    return value.bitwiseAND(F.lit(1 << 62)) != 0


def unflagged(value: Column) -> Column:
    return value.bitwiseAND(F.lit((1 << 62) - 1))


def packed(index: Column, owner: Column) -> Column:
    """44 bits of index below 18 of owner."""
    return F.shiftleft(owner.cast("long"), 44).bitwiseOR(index)


def packed_index(value: Column) -> Column:
    return value.bitwiseAND(F.lit((1 << 44) - 1))


def packed_owner(value: Column) -> Column:
    return F.shiftright(unflagged(value), 44)


def integer_or_inf(text: str) -> float:
    return math.inf if text.strip() == "inf" else int(text)
