"""Structured Streaming: lists that grow at their ends while their ranks are kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranking import rank
from ..plans.tables import children, keep, release, remove, shared_folder

_SCHEMA = "id bigint, root bigint, rank bigint, source string, epoch bigint"


class GrowingForest:
    """Ranks of a forest to which batches of (id, succ[, weight]) add elements above known ones.

    New elements point at each other or at known elements, whose ranks never change. A batch is ranked by itself,
    with the known elements it points at as its roots, and joined with their ranks.

    Every batch is a part in folder, named by its source and epoch: an epoch that comes again, as after a failure,
    takes its own part's place, and a new object on the same folder goes on where the last one was. When there are
    more than most_parts, all but the newest become one; an epoch in it is over and is passed by.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, most_parts: int = 16):
        self.spark, self.folder, self.most_parts = spark, folder or f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}", most_parts
        found = [p for p in children(spark, self.folder) if "_SUCCESS" in children(spark, f"{self.folder}/{p}")]
        self.base = max((p for p in found if p.startswith("base-")), default=None)
        self.over: dict[str, int] = {}
        if self.base is not None:
            self.over = {r.source: r.epoch for r in self._read([self.base]).groupBy("source").agg(F.max("epoch").alias("epoch")).collect()}
        self.parts = [p for p in found if not p.startswith("base-") and not self._is_over(*p.rsplit("-", 1))]

    def _is_over(self, source: str, epoch: str | int) -> bool:
        return int(epoch) <= self.over.get(source, -1)

    def _read(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(*(f"{self.folder}/{p}" for p in parts))

    def _all(self) -> list[str]:
        return ([self.base] if self.base is not None else []) + self.parts

    @property
    def ranked(self) -> DataFrame:
        return self._read(self._all()).select("id", "root", "rank")

    def add(self, batch: DataFrame, epoch: int | None = None, source: str = "add") -> None:
        """Without an epoch the batch is the source's next one."""
        if epoch is None:
            own = [int(p.rsplit("-", 1)[1]) for p in self.parts if p.rsplit("-", 1)[0] == source]
            epoch = max([self.over.get(source, -1), *own]) + 1
        if self._is_over(source, epoch):
            return
        name = f"{source}-{epoch}"
        before = self._read([p for p in self._all() if p != name])
        new = keep(batch)
        known = before.select(F.col("id").alias("k"))
        ends = new.select("succ").distinct().join(known, F.col("succ") == F.col("k")).select(F.col("k").alias("id"), F.col("k").alias("succ"), F.lit(0).cast("long").alias("weight"))
        weight = F.col("weight") if "weight" in new.columns else F.lit(1).cast("long")
        local = keep(rank(new.select("id", "succ", weight.alias("weight")).unionByName(ends), "doubling").join(ends.select("id"), "id", "left_anti"))
        above = before.select(F.col("id").alias("at"), F.col("root").alias("top"), F.col("rank").alias("far"))
        moved = local.withColumnRenamed("root", "at").join(above, "at", "left").select("id", F.coalesce("top", "at").alias("root"), (F.col("rank") + F.coalesce("far", F.lit(0))).alias("rank"))
        moved.withColumns({"source": F.lit(source), "epoch": F.lit(epoch).cast("long")}).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        release(local)
        release(new)
        self.parts = [p for p in self.parts if p != name] + [name]
        if len(self.parts) > self.most_parts:
            self._compact()

    def _compact(self) -> None:
        old, name = self._all()[:-1], f"base-{0 if self.base is None else int(self.base[5:]) + 1:09d}"
        self._read(old).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        for p in old:
            if not p.startswith("base-"):
                source, epoch = p.rsplit("-", 1)
                self.over[source] = max(int(epoch), self.over.get(source, -1))
        self.base, self.parts = name, self.parts[-1:]
        for p in old:
            remove(self.spark, f"{self.folder}/{p}")

    def start(self, stream: DataFrame, checkpoint: str, then: Callable[[DataFrame], None] | None = None, source: str = "stream"):  # noqa: ANN201
        """Runs over a stream of new elements; then sees all ranks after each batch."""

        def each(batch: DataFrame, epoch: int) -> None:
            self.add(batch, epoch, source)
            if then is not None:
                then(self.ranked)

        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
