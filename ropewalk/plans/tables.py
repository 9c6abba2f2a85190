"""Tables in the shared folder, with which iterative plans cut their lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: list[tuple[SparkSession, str]] = []

#: Rows of a file, at most: a split takes a file as 4 MB at least, so a task's rows are bounded however well they compress.
FILE_ROWS = 1 << 18
#: Rows of a task of a join, about: Spark puts parts together by their compressed bytes, and ids in order take few.
TASK_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and all executors share; a temporary folder only in local mode, where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = "file://" + tempfile.mkdtemp(prefix="ropewalk-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in files.listStatus(target)) if files.exists(target) else []


@atexit.register
def _clean() -> None:
    with contextlib.suppress(Exception):  # a session that ended leaves its folder
        for spark, path in _own:
            remove(spark, path)


def keep(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes df and reads it back: nothing above is computed again, and lost executors lose nothing.

    by names a boolean column by which the files are apart, so that a filter on it reads one half only.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ropewalk-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS)
    (writer.partitionBy(by) if by else writer).parquet(path)
    _own.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df dealt by columns for a join or an aggregation of about so many rows, into as many tasks as TASK_ROWS asks for.

    So few that two such tasks a core may hold them stay as they are: Spark deals those to all cores, and would make
    spark.sql.shuffle.partitions tasks of a smaller number here.
    """
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *by) if tasks > 2 * df.sparkSession.sparkContext.defaultParallelism else df


def keep_by(df: DataFrame, by: str) -> DataFrame:
    """Keeps a table that is to be joined or grouped by one column many times: a large one in buckets, so that this takes no shuffle."""
    spark = df.sparkSession
    kept = keep(df)
    rows = kept.count()
    if dealt(kept, rows, by) is kept:
        return kept
    n = max(-(-rows // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    path, name = f"{shared_folder(spark)}/ropewalk-{uuid.uuid4().hex}", f"ropewalk_{uuid.uuid4().hex}"
    writer = kept.repartition(n, by).write.option("compression", "zstd").option("path", path).bucketBy(n, by)
    writer.saveAsTable(name, format="parquet")
    _own.append((spark, path))
    out = spark.table(name)
    out._kept, out._name = path, name
    release(kept)
    return out


def release(df: DataFrame, part: str | None = None) -> None:
    """Removes a kept table, or a half of it, that nothing reads any more."""
    path = getattr(df, "_kept", None)
    if path and part:
        remove(df.sparkSession, f"{path}/{part}")
    elif path:
        if name := getattr(df, "_name", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        _own[:] = [x for x in _own if x[1] != path]
        remove(df.sparkSession, path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """Keeps what make gives, and removes all other tables that were kept meanwhile."""
    before = len(_own)
    out = keep(make())
    for spark, path in [x for x in _own[before:] if x[1] != out._kept]:
        _own.remove((spark, path))
        remove(spark, path)
    return out
