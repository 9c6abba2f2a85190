"""Ranking of what one task holds, by vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import StructureError


def chase(ids: np.ndarray, succ: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each element its root, or the first element outside ids, on its way; the distance; and whether that is a root.

    Doubling on places: as many vector steps as the logarithm of the longest way.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    at = np.minimum(np.searchsorted(ids, succ, sorter=order), max(0, n - 1))
    place = order[at] if n else at
    inside = (ids[place] == succ) & (succ != ids) if n else np.zeros(0, bool)
    to, dist = np.where(inside, place, np.arange(n)), np.where(inside, weight, 0)
    for _ in range(math.ceil(math.log2(max(2, n))) + 1):
        nxt = to[to]
        if np.array_equal(nxt, to):
            break
        dist = dist + dist[to]
        to = nxt
    else:
        if n and not np.array_equal(to[to], to):
            raise StructureError("elements reach no root: the structure has a cycle")
    if n and inside[to].any():
        raise StructureError("elements reach no root: the structure has a cycle")
    root = succ[to] == ids[to]
    return succ[to], dist + np.where(root, 0, weight[to]), root


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        ids, succ, weight, top, end = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("id", "succ", "weight", "top", "end"))
        if (~end & (ids == succ)).any():
            raise StructureError("elements reach no root: the structure has a cycle")
        anchor, rank, root = chase(ids, succ, np.where(end, 0, weight))
        if not root.all():
            raise StructureError("a successor is no id")
        order = np.argsort(ids, kind="stable")
        at = order[np.searchsorted(ids, anchor, sorter=order)]
        own = ~end
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(top[at][own]), pa.array((rank + weight[at])[own]), pa.array(np.ones(own.sum(), bool))], ["id", "root", "rank", "done"])


def finish(active: DataFrame, everything: DataFrame) -> DataFrame:
    """The last state (id, root, rank, done) of the active rows, in one task: they and the done ones they point at go there.

    For as many active rows as a task holds; there are no more of the others.
    """
    own = active.select("id", F.col("root").alias("succ"), F.col("rank").alias("weight"), F.col("id").alias("top"), F.lit(False).alias("end"))
    asked = active.select(F.col("root").alias("id")).distinct()
    ends = everything.filter("done").join(asked, "id", "left_semi").select("id", F.col("id").alias("succ"), F.col("rank").alias("weight"), F.col("root").alias("top"), F.lit(True).alias("end"))
    return own.unionByName(ends).coalesce(1).mapInArrow(_finish, "id bigint, root bigint, rank bigint, done boolean")
