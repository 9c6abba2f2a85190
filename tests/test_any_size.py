"""Library queries beyond the bounds that the usual tables stay within."""

import functools
import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from ropewalk import queries
from ropewalk.operators import gather, graphs, lookups
from ropewalk.plans import ranking
from ropewalk.plans import tables as kept
from ropewalk.sources import tables

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", ["basic_stats", "tree_stats", "size_histogram", "extensive_stats", "extensive_stats_reduced", "trace_lists"])
def test_statistics_beyond_one_task(spark, monkeypatch, name):
    want = sorted(map(repr, queries.QUERIES[name](spark, FOLDER).collect()))
    monkeypatch.setitem(ranking._PLANS, ranking.Strategy.GATHER, functools.partial(gather.gather, most_rows=100))
    monkeypatch.setattr(ranking, "choose", functools.partial(ranking.choose, block_rows=100))
    assert sorted(map(repr, queries.QUERIES[name](spark, FOLDER).collect())) == want


@pytest.mark.parametrize("name", ["ruler_segments", "chain_length_stats"])
def test_walks_longer_than_twelve(spark, tmp_path, name):
    n = 211  # a gap of 23 between two rulers
    spark.range(n).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def orders(spark, folder, n):
    spark.range(n).select(F.col("id").alias("o_orderkey")).write.parquet(f"{folder}/orders.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet/*.parquet'")
    return duck


def test_small_ranges_share_tasks(spark, tmp_path, monkeypatch):
    duck = orders(spark, tmp_path, 100_000)  # 25 ranges of 4096 ids
    parts, real = [], gather.keep

    def seen(df, by=None):
        parts.append(df.rdd.getNumPartitions())
        return real(df, by)

    monkeypatch.setattr(gather, "keep", seen)
    df = queries.QUERIES["rank_path_partial"](spark, str(tmp_path))
    assert max(parts) <= spark.sparkContext.defaultParallelism
    want = duck.execute(f"SELECT id, root, rank FROM ({queries.SQL['rank_path_partial']})").fetchall()
    assert sorted(map(tuple, df.select("id", "root", "rank").collect())) == sorted(want)


def test_ranges_of_a_task_are_apart():
    ids = np.array([5, 0, 1, 2, 3, 4, 6, 7])
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.minimum(ids + 1, 7)), pa.array(np.where(ids < 7, 1, 0))], ["id", "succ", "weight"])
    got = [r for b in gather._contract(iter([batch]), 2) for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
    assert sorted(got) == [(i, 4, 4 - i, False) for i in range(4)] + [(i, 7, 7 - i, True) for i in range(4, 8)]


def test_paths_are_joined_without_broadcast(spark, tmp_path):
    orders(spark, tmp_path, 1000)
    df = tables.path(spark, str(tmp_path), "partial")
    df.collect()
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_joins_in_tasks_of_counted_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept, "TASK_ROWS", 1000, raising=False)
    requests, state = spark.range(70_000).selectExpr("id", "id DIV 2 AS root"), spark.range(70_000).selectExpr("id AS root", "-id AS value")
    met = lookups.meet(requests, state, "root", 70_000)
    assert met.count() == 70_000 and met.rdd.getNumPartitions() == 70
    duck = orders(spark, tmp_path, 20_000)
    df = queries.QUERIES["rank_ruling_set_contracted"](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() >= 20
    want = duck.execute(f"SELECT id, root, rank FROM ({queries.SQL['rank_ruling_set_contracted']})").fetchall()
    assert sorted(map(tuple, df.select("id", "root", "rank").collect())) == sorted(want)


def test_forest_of_many_edges_is_contracted_and_bucketed(spark, monkeypatch):
    rng = random.Random(3)
    pairs = {(a, b) for low in (0, 100) for a, b in (sorted(rng.sample(range(low, low + 60), 2)) for _ in range(120))}
    edges, vertices = graphs.both_directions(spark.createDataFrame(sorted(pairs), "src bigint, dst bigint")), spark.range(200)
    near = {v: sorted({b for a, b in pairs if a == v} | {a for a, b in pairs if b == v}) for v in range(200)}
    want = {}
    for v in range(200):
        if v not in want:
            want[v], level = v, [v]
            while level:
                new = {}
                for a in sorted(level):
                    new |= {b: a for b in near[a] if b not in want and b not in new}
                want |= new
                level = list(new)
    sought, real = [], graphs.components

    def seen(e):
        sought.append(e.count())
        return real(e)

    monkeypatch.setattr(graphs, "components", seen)
    monkeypatch.setattr(graphs, "MANY_EDGES", 10, raising=False)
    monkeypatch.setattr(kept, "TASK_ROWS", 40, raising=False)
    assert dict(graphs.bfs_forest(edges, vertices).select("id", "succ").collect()) == want
    assert sought[0] < len(pairs) / 2
    assert not spark.catalog.listTables()
