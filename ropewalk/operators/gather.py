"""Ranking inside one task, and contraction of what lies inside each of many tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import Metrics
from ..plans.tables import FILE_ROWS, dealt, keep, release
from ..schema import weighted
from .chase import chase
from .doubling import TAIL, from_state

#: Rows that one task ranks by itself: 24 bytes each in Arrow, and about 100 at work.
BLOCK_ROWS = 2_000_000


def _contract(batches: Iterator[pa.RecordBatch], blocks: int = 1) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        ids, succ, weight = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("id", "succ", "weight"))
        del held
        order = np.argsort(ids, kind="stable")
        own = ids[order]
        # equal ids stay together
        cuts = np.unique(np.searchsorted(own, own[[k * len(own) // blocks for k in range(1, blocks)]])) if len(own) else []
        for at in np.split(order, cuts):
            anchor, offset, root = chase(ids[at], succ[at], weight[at])
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(anchor), pa.array(offset), pa.array(root)], ["id", "root", "rank", "done"])


def local_chase(succ: DataFrame, parts: int, tasks: int | None = None) -> DataFrame:
    """(id, root, rank, done) with the structure dealt into ranges of ids: done where the root is in the same range.

    Else root is the first element of another range on the way. Made for trees too: every element is sent to the
    exit of its own local tree. A task takes one range, or where there are fewer tasks several, one after the other.
    """
    own = weighted(succ)
    tasks = min(parts, tasks or parts)
    ranges = own.coalesce(1) if tasks == 1 else own.repartitionByRange(tasks, "id")
    return ranges.mapInArrow(partial(_contract, blocks=-(-parts // tasks)), "id bigint, root bigint, rank bigint, done boolean")


def gather(succ: DataFrame, most_rows: int | None = None) -> DataFrame:
    """(id, root, rank) in one task.

    More than BLOCK_ROWS rows are ranked in as many tasks as that needs, and between them (see contracted); where
    most_rows is given, more than that are refused.
    """
    if most_rows is not None and succ.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows for one task")
    if most_rows is None and succ.count() > BLOCK_ROWS:
        return contracted(succ, BLOCK_ROWS)
    lost = F.when(F.col("done"), F.col("root")).otherwise(F.raise_error(F.format_string("successor %s is no id", "root")).cast("long"))
    return local_chase(succ, 1).select("id", lost.alias("root"), "rank")


def contracted(succ: DataFrame, block_rows: int = BLOCK_ROWS, base: Callable[[DataFrame], DataFrame] | None = None, tail: int = TAIL, metrics: Metrics | None = None) -> DataFrame:
    """(id, root, rank): chase in ranges of about block_rows ids, rank between them, and put both together.

    Only elements that another range points to take part in the ranking between ranges, by doubling or by base: few
    where ids follow the structure. A list stays a list, a forest a forest. Small ranges share tasks of FILE_ROWS rows:
    a task for each would send its bounds' sample and its report to the driver. The structure is kept, not made again
    for its count, its sample and its ranges.
    """
    metrics = metrics if metrics is not None else Metrics()
    own = keep(weighted(succ))
    n = own.count()
    tasks = max(-(-n // FILE_ROWS), own.sparkSession.sparkContext.defaultParallelism)
    local = keep(local_chase(own, max(1, -(-n // block_rows)), tasks), "done")
    release(own)
    out = local.filter("not done")
    entries = out.select(F.col("root").alias("id")).distinct()
    metrics.more["entries"] = entries.count()
    if not metrics.more["entries"]:
        return local.select("id", "root", "rank")
    state = dealt(local, n, "id").join(dealt(entries, n, "id").hint("merge"), "id")
    if base is None:
        ranked = from_state(state, tail=tail, metrics=metrics)
    else:
        steps = state.select("id", F.col("root").alias("succ"), F.col("rank").alias("weight"))
        roots = state.filter("done").select(F.col("root").alias("id"), F.col("root").alias("succ"), F.lit(0).cast("long").alias("weight")).distinct()
        ranked = keep(base(keep(steps.filter("id != succ").unionByName(roots))))
    asking = dealt(out.select("id", F.col("root").alias("at"), F.col("rank").alias("near")), n, "at")
    far = asking.join(dealt(ranked.withColumnRenamed("id", "at"), n, "at").hint("merge"), "at", "left")
    lost = F.coalesce("root", F.raise_error(F.format_string("successor %s is no id", "at")).cast("long")).alias("root")
    return local.filter("done").select("id", "root", "rank").unionByName(far.select("id", lost, (F.col("near") + F.col("rank")).alias("rank")))
