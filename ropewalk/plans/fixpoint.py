"""The driver's loop over rounds of a distributed plan."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import StructureError
from .tables import keep, release


@dataclass
class Metrics:
    """Rows still active and seconds, for each round."""

    active: list[int] = field(default_factory=list)
    seconds: list[float] = field(default_factory=list)
    more: dict[str, Any] = field(default_factory=dict)

    @property
    def rounds(self) -> int:
        return len(self.active)


@dataclass
class Contraction:
    """Taking rows out instead of sending all of them in every round.

    shorten(active, level, rows) gives the active rows without those that the level takes out, which none of the rest
    point at any more; expand(active, done, level, rows) gives the last state of those that it took out. It begins after
    some rounds if a share of the rows is still active, and ends at least rows.
    """

    shorten: Callable[[DataFrame, int, int], DataFrame]
    expand: Callable[[DataFrame, DataFrame, int, int], DataFrame]
    after: int = 4
    share: float = 0.75
    least: int = 1 << 18


def round_limit(rows: int) -> int:
    """Rounds of doubling that suffice for any structure without a cycle."""
    return max(1, math.ceil(math.log2(max(2, rows)))) + 1


def shrink(
    start: DataFrame,
    step: Callable[[DataFrame, DataFrame, int], DataFrame],
    limit: int | None = None,
    metrics: Metrics | None = None,
    tail: int = 0,
    finish: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    contraction: Contraction | None = None,
) -> DataFrame:
    """Applies step to the rows that aren't done until all are; gives all rows back, in start's columns.

    step(active, everything, left) gives the next state of the active rows, of which there are left; a row that finds
    no partner may be left out, and that raises. A round writes the rows that were active before it, once, and drops their former state; rows that are done
    are never written again. As soon as tail rows or fewer are active, finish(active, everything) gives the last
    state of all of them. More than limit rounds raise. contraction takes over once, while rows are many, where rounds
    prove to be of little use.
    """
    metrics = metrics if metrics is not None else Metrics()
    counts = F.count(F.lit(1)), F.count_if(~F.col("done"))
    tables = [keep(start, "done")]
    rows, left = tables[0].agg(*counts).first()
    limit = limit or round_limit(rows)
    begun, first, levels, rest = metrics.rounds, left, [], None
    while left:
        if contraction is not None and rest is None and left > contraction.least and metrics.rounds - begun >= contraction.after and left > contraction.share * first:
            levels = _contract(tables[-1], left, contraction)
            table, left = levels.pop()
            tables.append(table)
            rest, limit = left, metrics.rounds + round_limit(left)
            metrics.more["contracted_levels"] = len(levels)
            continue
        last = finish is not None and left <= tail
        if metrics.rounds >= limit and not last:
            raise StructureError(f"{left} elements reach no root: the structure has a cycle")
        began = time.perf_counter()
        active = tables[-1].filter("not done")
        everything = reduce(DataFrame.unionByName, [t.filter("done") for t in tables], active)
        tables.append(keep(finish(active, everything) if last else step(active, everything, left), "done"))
        rows, now = tables[-1].agg(*counts).first()
        if rows != left:
            raise StructureError(f"a successor is no id, or an id is repeated: {left} rows became {rows}")
        release(tables[-2], "done=false")
        if last:
            metrics.more["finished_in_one_task"] = left
        left = now
        metrics.active.append(left)
        metrics.seconds.append(time.perf_counter() - began)
    ended = [t.filter("done") for t in tables]
    for k, (table, many) in reversed(list(enumerate(levels))):
        ended.append(keep(contraction.expand(table.filter("not done"), reduce(DataFrame.unionByName, ended), k, many), "done"))
        gone, left = ended[-1].count(), levels[k + 1][1] if k + 1 < len(levels) else rest
        if gone + left != many:
            raise StructureError(f"a successor is no id, or an id is repeated: {many} rows became {gone + left}")
        release(table, "done=false")
    return reduce(DataFrame.unionByName, ended).select(*start.columns)


def _contract(table: DataFrame, left: int, how: Contraction) -> list[tuple[DataFrame, int]]:
    """Tables of each level's active rows and their number, from all to those that are few enough or grow no fewer."""
    levels, idle = [(table, left)], 0
    while levels[-1][1] > how.least and idle < 4:
        table, many = levels[-1]
        less = keep(how.shorten(table.filter("not done"), len(levels) - 1, many), "done")
        levels.append((less, less.count()))
        idle += levels[-1][1] > 0.9 * many
    return levels
