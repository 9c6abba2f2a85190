"""The public ranking call: strategies by name, and a choice among them."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import doubling as d
from ..operators import forest, gather, ruling
from ..schema import validate
from .fixpoint import Metrics


class Strategy(str, Enum):
    AUTO = "auto"
    GATHER = "gather"
    DOUBLING = "doubling"
    DISTINCT = "distinct"
    REDUCED = "reduced-volume"
    BOTH_WAYS = "both-ways"
    CONTRACTED = "contracted"
    HIGH_DEGREE = "high-degree"
    RULING_SET = "ruling-set"
    RULING_SET_INVERTED = "ruling-set-inverted"
    FOREST_RULING_SET = "forest-ruling-set"
    EULER = "euler-tour"
    EULER_PROXIES = "euler-tour-proxies"
    # other ways of moving messages, with the same plan here as DOUBLING
    ASYNC = "async-doubling"
    RMA_PASSIVE = "rma-passive"
    RMA_FENCED = "rma-fenced"
    GRID = "grid-doubling"


def _distinct(succ: DataFrame, tail: int = d.TAIL, metrics: Metrics | None = None) -> DataFrame:
    return d.doubling(succ, distinct_first=True, tail=tail, metrics=metrics)


def _doubling(succ: DataFrame, tail: int = d.TAIL, metrics: Metrics | None = None) -> DataFrame:
    return d.doubling(succ, tail=tail, metrics=metrics)


def _euler_proxies(succ: DataFrame, degree: int = 16, base: Callable[[DataFrame], DataFrame] = d.doubling) -> DataFrame:
    return forest.euler_rank(succ, degree, base)


def _euler(succ: DataFrame, degree: int | None = None, base: Callable[[DataFrame], DataFrame] = d.doubling) -> DataFrame:
    return forest.euler_rank(succ, degree, base)


_PLANS: dict[Strategy, Callable[..., DataFrame]] = {
    Strategy.GATHER: gather.gather,
    Strategy.DOUBLING: _doubling,
    Strategy.DISTINCT: _distinct,
    Strategy.REDUCED: d.doubling_reduced_volume,
    Strategy.BOTH_WAYS: d.doubling_both_ways,
    Strategy.CONTRACTED: gather.contracted,
    Strategy.HIGH_DEGREE: d.without_high_degrees,
    Strategy.RULING_SET: ruling.ruling_set,
    Strategy.RULING_SET_INVERTED: ruling.ruling_set_inverted,
    Strategy.FOREST_RULING_SET: ruling.forest_ruling_set,
    Strategy.EULER: _euler,
    Strategy.EULER_PROXIES: _euler_proxies,
} | dict.fromkeys((Strategy.ASYNC, Strategy.RMA_PASSIVE, Strategy.RMA_FENCED, Strategy.GRID), _doubling)
#: Options of the strategies by name; rule and metrics are for callers of the operators.
OPTIONS = ("tail", "block_rows", "most_rows", "degree", "every", "ruler", "factor", "rounds", "levels", "base")


def options_of(strategy: Strategy | str) -> list[str]:
    """The options that a strategy knows. Those of ruling-set-inverted are ruling-set's."""
    plan = _PLANS[Strategy.RULING_SET if Strategy(strategy) is Strategy.RULING_SET_INVERTED else Strategy(strategy)]
    return [o for o in OPTIONS if o in inspect.signature(plan).parameters]


#: Predecessors of one element that make it hot.
HOT = 1000


def choose(succ: DataFrame, block_rows: int = gather.BLOCK_ROWS, near: float = 0.5) -> Strategy:
    """The plan for a structure, from its size and shape.

    gather for what one task can hold; contracted where most steps stay within block_rows ids; distinct where an
    element has many predecessors; for lists ruling-set where it is estimated to shuffle less than half of what
    doubling does; else doubling.
    """
    n, inside, roots = succ.agg(F.count(F.lit(1)), F.avg((F.abs(F.col("succ") - F.col("id")) < block_rows // 2).cast("double")), F.count_if(F.col("id") == F.col("succ"))).first()
    if n <= block_rows:
        return Strategy.GATHER
    if inside >= near:
        return Strategy.CONTRACTED
    most = succ.filter("id != succ").groupBy("succ").count().agg(F.max("count")).first()[0] or 0
    if most >= HOT:
        return Strategy.DISTINCT
    cost = estimate(n, n // max(1, roots))
    return Strategy.RULING_SET if most <= 1 and cost.ruling < cost.doubling / 2 else Strategy.DOUBLING


def rank(succ: DataFrame, strategy: Strategy | str = Strategy.AUTO, check: bool = True, metrics: Metrics | None = None, **options: Any) -> DataFrame:
    """(id, root, rank) of (id, succ[, weight]): each element's root and its distance to it.

    Roots point at themselves. check looks for repeated ids and lost successors first; cycles are found in any case.
    options are the strategy's (see options_of); base, which ranks what a strategy has reduced, may be a strategy too.
    metrics is filled by strategies that work in rounds.
    """
    succ = validate(succ) if check else succ
    strategy = Strategy(strategy)
    if strategy is Strategy.AUTO:
        strategy, options = choose(succ), {}
    elif unknown := set(options) - set(options_of(strategy)):
        raise ValueError(f"{strategy.value} has no option {', '.join(sorted(unknown))}; it has: {', '.join(options_of(strategy)) or 'none'}")
    else:
        base = options.get("base")
        if isinstance(base, str):
            options["base"] = lambda x: rank(x, base, check=False)
    plan = _PLANS[strategy]
    if metrics is not None and "metrics" in inspect.signature(plan).parameters:
        options["metrics"] = metrics
    return plan(succ, **options)


@dataclass(frozen=True)
class Estimate:
    """Rows shuffled by doubling and by ruling sets."""

    doubling: float
    ruling: float


def estimate(n: int, longest: int, every: int = 4, rounds: int = 6) -> Estimate:
    """Of lists with n elements, the longest with so many; rulers are one element in every, and walk some rounds.

    A round of doubling sends each element's pointer and its reply. A walk sends the fronts that have met no ruler,
    the rulers and all that was not reached double among themselves, and the rest gets its rank from its ruler.
    """
    steps = max(1, longest.bit_length())
    going = [(1 - 1 / every) ** k for k in range(rounds + 1)]
    small = n * (1 / every + (1 - 1 / every) * going[-1])
    return Estimate(2.0 * n * steps, 2.0 * n / every * sum(going[:-1]) + 2.0 * small * max(1, (longest // 2).bit_length()) + 2.0 * n)


def timed(succ: DataFrame, strategy: Strategy | str, iterations: int = 1, metrics: Metrics | None = None, **options: Any) -> tuple[DataFrame, list[float]]:
    """The ranking and the seconds of each of some runs to their end; metrics is of all of them."""
    seconds, out = [], None
    for _ in range(iterations):
        began = time.perf_counter()
        out = rank(succ, strategy, check=False, metrics=metrics, **options)
        out.write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - began)
    return out, seconds
