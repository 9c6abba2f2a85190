"""Graphs, generators, statistics, scans, reports, streams and the command line."""

import json

import pytest
from pyspark.sql import functions as F
from ropewalk import cli
from ropewalk.functions import scalars
from ropewalk.operators import graphs, lookups, prefix, stats
from ropewalk.operators.components import components
from ropewalk.plans.ranking import rank
from ropewalk.plans.report import row_of, spread, write_report
from ropewalk.sources import generators as gen
from ropewalk.sources import logs, tables
from ropewalk.streaming.chains import GrowingForest


@pytest.fixture(scope="module")
def square(spark):
    pairs = [(1, 2, 5), (2, 3, 1), (3, 4, 1), (4, 1, 9), (10, 11, 2)]
    edges = graphs.both_directions(spark.createDataFrame(pairs, "src bigint, dst bigint, weight bigint"))
    return edges, spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 10, 11, 20)], "id bigint")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components_and_forests(square):
    edges, vertices = square
    assert rows(components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))) == [(2, 1), (3, 1), (4, 1), (11, 10)]
    assert rows(graphs.bfs_forest(edges, vertices)) == [(1, 1), (2, 1), (3, 2), (4, 1), (10, 10), (11, 10), (20, 20)]
    assert rows(graphs.lightest_edge_forest(edges, vertices)) == [(1, 2), (2, 2), (3, 2), (4, 3), (10, 10), (11, 10), (20, 20)]
    assert rows(graphs.edges_to_succ(edges, vertices))[-1] == (20, 20)
    assert rows(graphs.bfs(edges, vertices.filter("id = 1"), F.col("weight") < 6)) == [(1, 1, 0), (2, 1, 1), (3, 2, 2), (4, 3, 3)]


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src bigint, dst bigint, weight bigint")
    assert rows(graphs.bfs_forest(none, spark.range(3))) == [(0, 0), (1, 1), (2, 2)]


@pytest.mark.parametrize("spec", ["type=path;n=40", "type=path;n=40;permute=true;permutation_prob=0.3", "type=path;n=40;permute=true;p=0.8", "type=star;n=9", "type=tailed-star;n=20", "type=caterpillar;n=21;legs=2", "type=stars;n=30;roots=4", "type=random-tree;n=50"])
def test_generated_forests(spark, spec):
    own = gen.from_spec(spark, spec)
    assert stats.violations(own, rank(own, "gather")).count() == 0


@pytest.mark.parametrize("kind", ["gnm-undirected", "rmat", "rgg2d"])
@pytest.mark.parametrize("processing", ["bfs", "eulertour", "eulertour-break-high-degree"])
def test_generated_graphs(spark, kind, processing):
    own = gen.from_spec(spark, f"type={kind};n=64;m=100", processing)
    assert stats.violations(own, rank(own, "gather")).count() == 0


def test_relabelling_keeps_shape(spark):
    own = gen.path(spark, 30)
    assert row_of(stats.basic_stats(rank(gen.relabelled(own, 30), "gather"))) == row_of(stats.basic_stats(rank(own, "gather")))


def test_stats_of_nothing(spark):
    none = spark.createDataFrame([], "id bigint, root bigint, rank bigint")
    assert row_of(stats.stats(none, "extensive"))["avg_size"] == 0
    assert stats.stats(none, "none") is None


def test_dense_ids_and_overlaps(spark):
    ids = spark.createDataFrame([(i,) for i in (5, 100, 7, 10**12)], "id bigint")
    assert rows(lookups.dense_ids(ids)) == [(5, 0), (7, 1), (100, 2), (10**12, 3)]
    assert lookups.dense_ids(ids.limit(0)).count() == 0
    a = spark.createDataFrame([(0, 0, 5), (1, 5, 9)], "part bigint, low bigint, high bigint")
    b = spark.createDataFrame([(0, 0, 3), (1, 3, 9)], "part bigint, low bigint, high bigint")
    assert rows(lookups.overlaps(a, b)) == [(0, 0, 0, 3), (0, 1, 3, 5), (1, 1, 5, 9)]


def test_rebalance(spark):
    df = spark.range(100).coalesce(1)
    assert prefix.rebalance(df, 4).rdd.getNumPartitions() == 4
    assert row_of(prefix.size_stats(prefix.partition_sizes(df)))["total_size"] == 100


def test_scalars(spark):
    for s in ("dehne", "heuristic", "sanders", "ultimate", "ultimate-sanders", "limit-rounds"):
        for n in (0, 1, 2, 1000):
            for p in (1, 8):
                assert 0 <= scalars.ruler_rate(s, n, p, 0.5) <= 1
    assert scalars.integer_or_inf("inf") == float("inf")
    r = spark.range(1).select(scalars.safe_ratio(F.lit(1), F.lit(0)).alias("a"), scalars.ceil_div(F.lit(7), F.lit(2)).alias("b"), scalars.is_flagged(scalars.flagged(F.lit(5).cast("long"))).alias("c")).first()
    assert tuple(r) == (0.0, 4, True)


def test_report_tables(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"config": {"input": "type=path;n=8", "p": i}, "times": [9, 1 + i, 3]}))
    (tmp_path / "empty.json").write_text("")
    r = logs.extract(logs.read_reports(spark, f"{tmp_path}/*.json"), {"p": "$.config.p", "input": "$.config.input"})
    each = logs.warm(logs.iterations(logs.options(r, "input_text", ["type", "n"]), {"t": "$.times"}))
    assert each.count() == 4
    s = logs.summary(each, ["type"], "t", least=2)
    assert tuple(s.select("nrows", "mean", "least", "largest").first()) == (4, 2.25, 1.0, 3.0)
    assert logs.means_long(each.select("type", "p", "t"), ["t"]).count() == 2
    coded, names = logs.encoded(logs.labelled(each, ["type", "n"]), "label")
    assert coded.count() == 4 and names.count() == 1
    logs.write_parts(coded.select("label", "t"), str(tmp_path / "csv"), "label")
    assert logs.combined(s, s.drop("mean")).filter("mean is null").count() == 1
    write_report({"a": spread([1.0, 2.0])}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["a"]["sum"] == 3.0


def test_growing_forest(spark, tmp_path):
    f = GrowingForest(spark)
    f.add(spark.createDataFrame([(1, 1), (2, 1)], "id bigint, succ bigint"))
    src = tmp_path / "in"
    spark.createDataFrame([(3, 2), (4, 3), (5, 5)], "id bigint, succ bigint").write.parquet(str(src))
    stream = spark.readStream.schema("id bigint, succ bigint").parquet(str(src))
    f.start(stream, str(tmp_path / "cp")).awaitTermination(60)
    assert rows(f.ranked) == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3), (5, 5, 0)]


def test_growing_forest_takes_an_epoch_once(spark, tmp_path):
    folder = str(tmp_path / "forest")
    batches = [[(1, 1), (2, 1)], [(3, 2), (4, 3)], [(5, 4), (6, 6)], [(7, 5)], [(8, 7), (9, 6)]]
    made = [spark.createDataFrame(b, "id bigint, succ bigint") for b in batches]
    f = GrowingForest(spark, folder, most_parts=2)
    for epoch, b in enumerate(made[:3]):
        f.add(b, epoch)
        f.add(b, epoch)  # as foreachBatch does after a failure
    g = GrowingForest(spark, folder, most_parts=2)  # the driver was lost
    for epoch, b in enumerate(made[2:], 2):
        g.add(b, epoch)
    g.add(made[0], 0)  # long over
    want = rank(spark.createDataFrame([r for b in batches for r in b], "id bigint, succ bigint"), "gather")
    assert rows(g.ranked) == rows(want) and len(g.parts) <= 2 and g.base is not None
    assert rows(GrowingForest(spark, folder).ranked) == rows(want)


def test_levels_are_seen_and_put_together(spark):
    path = graphs.both_directions(spark.range(40).selectExpr("id AS src", "id + 1 AS dst"))
    seen = []
    found = graphs.bfs(path, spark.createDataFrame([(0,)], "id bigint"), on_level=lambda k, df: seen.append((k, df.count())))
    assert seen == [(k, 1) for k in range(41)]
    assert sorted(map(tuple, found.collect())) == [(k, max(0, k - 1), k) for k in range(41)]
    assert graphs.bfs(path, spark.createDataFrame([(0,)], "id bigint"), max_levels=3).count() == 4
    assert graphs.bfs(path, spark.createDataFrame([], "id bigint")).count() == 0


def test_command_line(spark, tmp_path):
    out = tmp_path / "report.json"
    cli.run(spark, cli.parse(["--input", "type=path;n=50;permute=true", "--algorithm", "gather", "--verify-level", "2", "--statistics-level", "extensive", "--output-file", str(out), "--result", str(tmp_path / "res")]))
    report = json.loads(out.read_text())
    assert report["wrong"] == 0 and report["stats"]["max_size"] == 50
    assert spark.read.parquet(str(tmp_path / "res")).count() == 50


def test_command_line_options(spark, tmp_path):
    out = str(tmp_path / "report.json")
    for more in (["ruling-set", "--every", "3", "--rounds", "2", "--base", "distinct", "--block-rows", "20"], ["doubling", "--tail", "0"], ["contracted", "--block-rows", "10"], ["forest-ruling-set", "--levels", "2"]):
        report = cli.run(spark, cli.parse(["--input", "type=path;n=60;permute=true", "--output-file", out, "--algorithm", *more]))
        assert report["wrong"] == 0 and report["stats"]["max_rank"] == 59
        assert report["rounds"]["number"] == len(report["rounds"]["active"])
        assert (report["rounds"]["number"] > 3) == (more[0] == "doubling")
    with pytest.raises(ValueError, match="has no option"):
        cli.run(spark, cli.parse(["--input", "type=path;n=60", "--output-file", out, "--algorithm", "doubling", "--every", "3"]))


def test_lightest_edges_without_a_sort(spark):
    top = (1 << 63) - 1
    rows = [(1, 2, -5), (1, 3, -5), (1, 4, 7), (2, 1, -5), (3, 1, top), (3, top, -top - 1), (4, 1, 7), (4, 5, 0), (5, top, top), (top, 3, -top - 1)]
    edges, vertices = spark.createDataFrame(rows, "src long, dst long, weight long"), spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, top)], "id long")
    plans, plain = [], graphs.keep
    graphs.keep = lambda df: plans.append(df._jdf.queryExecution().toString()) or plain(df)
    try:
        found = {tuple(r) for r in graphs.lightest_edge_forest(edges, vertices).collect()}
    finally:
        graphs.keep = plain
    assert found == {(1, 1), (2, 1), (3, 3), (4, 5), (5, top), (6, 6), (top, 3)}
    assert plans and not any("SortAggregate" in p for p in plans)


def test_purchases_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    spark.range(400).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(2000).selectExpr("id % 400 AS l_orderkey", "id % 90 AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(7).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(90).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(tables, "TASK_ROWS", 100, raising=False)
    edges, vertices = tables.purchases(spark, str(tmp_path))
    assert {(r.src, r.dst) for r in edges.collect() if r.src < 7} == {(i % 400 % 7, i % 90 + tables.PART) for i in range(2000)}
    assert edges.rdd.getNumPartitions() == 40 and vertices.count() == 97
