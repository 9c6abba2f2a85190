"""Every strategy against a walk in Python, over small structures and odd inputs."""

import random

import pytest
from ropewalk.operators import forest, gather, lookups, predicates, ruling, stats
from ropewalk.operators import doubling as dbl
from ropewalk.operators.doubling import doubling
from ropewalk.plans.fixpoint import Metrics
from ropewalk.plans.ranking import Strategy, choose, estimate, options_of, rank
from ropewalk.schema import SUCC, StructureError, validate

LISTS = [Strategy.BOTH_WAYS, Strategy.RULING_SET, Strategy.RULING_SET_INVERTED]
UNIT = [Strategy.REDUCED, Strategy.EULER, Strategy.EULER_PROXIES]
FORESTS = [Strategy.GATHER, Strategy.DOUBLING, Strategy.DISTINCT, Strategy.CONTRACTED, Strategy.HIGH_DEGREE, Strategy.FOREST_RULING_SET]


def walk(succ):
    to, w = {i: s for i, s, _ in succ}, {i: x for i, _, x in succ}
    out = set()
    for i in to:
        v, r = i, 0
        while to[v] != v:
            r += w[v]
            v = to[v]
        out.add((i, v, r))
    return out


def got(df):
    return {tuple(r) for r in df.select("id", "root", "rank").collect()}


def table(spark, rows):
    return spark.createDataFrame(rows, SUCC)


def random_forest(n, seed, weights=(1,)):
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), n)
    return [(v, v, 0) if k == 0 or rng.random() < 0.1 else (v, ids[rng.randrange(max(0, k - 6), k)], rng.choice(weights)) for k, v in enumerate(ids)]


def random_lists(n, seed, weights=(1,)):
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), n)
    return [(v, v, 0) if k == 0 or rng.random() < 0.05 else (v, ids[k - 1], rng.choice(weights)) for k, v in enumerate(ids)]


@pytest.mark.parametrize("strategy", FORESTS)
def test_forest_strategies(spark, strategy):
    rows = random_forest(120, 3, (1, 2, 5))
    assert got(rank(table(spark, rows), strategy)) == walk(rows)


@pytest.mark.parametrize("strategy", UNIT)
def test_unit_weight_strategies(spark, strategy):
    rows = random_forest(80, 4)
    assert got(rank(table(spark, rows), strategy)) == walk(rows)


@pytest.mark.parametrize("strategy", LISTS)
def test_list_strategies(spark, strategy):
    rows = random_lists(120, 5, (1, 3))
    assert got(rank(table(spark, rows), strategy)) == walk(rows)


def test_negative_and_zero_weights(spark):
    rows = random_forest(60, 6, (-2, 0, 1))
    for s in (Strategy.GATHER, Strategy.DOUBLING, Strategy.CONTRACTED):
        assert got(rank(table(spark, rows), s)) == walk(rows)


def test_small_blocks_and_local_chase(spark):
    rows = random_forest(200, 7)
    m = Metrics()
    assert got(gather.contracted(table(spark, rows), block_rows=30, metrics=m)) == walk(rows)
    assert m.more["entries"] > 0
    local = gather.local_chase(table(spark, rows), 5)
    assert local.count() == 200


def test_empty_single_and_isolated(spark):
    for rows in ([], [(7, 7, 0)], [(1, 1, 0), (5, 5, 0), (9, 9, 0)]):
        for s in FORESTS + LISTS + UNIT:
            assert got(rank(table(spark, rows), s)) == walk(rows), (s, rows)


@pytest.mark.parametrize("strategy", [Strategy.GATHER, Strategy.DOUBLING, Strategy.CONTRACTED])
def test_cycles_raise(spark, strategy):
    with pytest.raises(Exception, match="cycle"):
        rank(table(spark, [(1, 2, 1), (2, 3, 1), (3, 1, 1), (4, 4, 0)]), strategy).collect()


def test_bad_structures_raise(spark):
    with pytest.raises(StructureError, match="repeated"):
        validate(table(spark, [(1, 1, 0), (1, 1, 0)]))
    with pytest.raises(StructureError, match="no id"):
        validate(table(spark, [(1, 2, 1)]))
    with pytest.raises(StructureError, match="negative"):
        validate(table(spark, [(-1, -1, 0)]))
    with pytest.raises(Exception, match="is no id"):
        doubling(table(spark, [(1, 2, 1), (3, 3, 0)])).collect()
    with pytest.raises(StructureError, match="lists"):
        ruling.ruling_set(table(spark, [(1, 3, 1), (2, 3, 1), (3, 3, 0)]))
    with pytest.raises(ValueError, match="one task"):
        gather.gather(table(spark, random_lists(20, 1)), most_rows=10)


def test_local_recurrence_finds_faults(spark):
    rows = random_forest(50, 8)
    good = rank(table(spark, rows), "gather")
    assert stats.violations(table(spark, rows), good).count() == 0
    bad = good.selectExpr("id", "root", f"if(id = {rows[10][0]}, rank + 1, rank) AS rank")
    assert stats.violations(table(spark, rows), bad).count() > 0
    assert stats.mismatches(good, bad).count() == 1


#: Two blocks' worth of a packing case: active elements in a chain of an otherwise idle array.
PACK = [(1, 6, 1), (6, 8, 1), (8, 10, 1), (10, 14, 1), (14, 15, 1), (15, 18, 1), (18, 18, 0)]


def test_pack_and_unpack(spark):
    rows = PACK + [(i, i, 0) for i in range(20) if i not in dict((a, 0) for a, _, _ in PACK)]
    own = table(spark, rows)
    packed, names = lookups.pack(own, spark.createDataFrame([(a,) for a, _, _ in PACK], "id bigint"))
    assert {tuple(r) for r in packed.collect()} == {(k, min(k + 1, 6), int(k < 6)) for k in range(7)}
    assert got(lookups.unpack(doubling(packed), names)) == {(a, 18, 6 - k) for k, (a, _, _) in enumerate(PACK)}


def test_identity_path(spark):
    rows = [(i, min(i + 1, 11), int(i < 11)) for i in range(12)]
    assert got(rank(table(spark, rows), "auto")) == {(i, 11, 11 - i) for i in range(12)}


def test_post_invert_and_reverse(spark):
    rows = random_lists(60, 9)
    own = table(spark, rows)
    assert got(ruling.post_invert(rank(predicates.reverse_list(own), "gather"))) == walk(rows)


def test_proxies_bound_degrees(spark):
    rows = [(0, 0, 0)] + [(i, 0, 1) for i in range(1, 100)]
    own, proxies = forest.with_proxies(table(spark, rows), degree=4, fan=8)
    assert 0 < proxies.count() <= 8
    assert predicates.in_degrees(own).agg({"degree": "max"}).first()[0] < 40
    assert got(forest.euler_rank(table(spark, rows), degree=4)) == walk(rows)


def test_leaf_flags(spark):
    own = table(spark, [(1, 2, 1), (2, 2, 0), (3, 3, 0)])
    assert {r.id for r in predicates.leaves(own).collect()} == {1, 3}
    assert {r.id for r in predicates.leaves(own, proper_only=True).collect()} == {1}


def test_choice(spark):
    near = table(spark, [(i, min(i + 1, 99), 1) for i in range(100)])
    far = table(spark, [(i, (i * 37 + 50) % 100, 1) for i in range(100)])
    assert choose(near) is Strategy.GATHER
    assert choose(near, block_rows=10) is Strategy.CONTRACTED
    assert choose(far, block_rows=10) is Strategy.DOUBLING
    assert estimate(10**6, 10**6).doubling > 0


@pytest.mark.parametrize("tail", [0, 40, 100, 10**6])
def test_tail_in_one_task(spark, tail):
    rows, chains = random_forest(150, 11, (0, 1, 4)), random_lists(150, 12)
    m = Metrics()
    for distinct in (False, True):
        assert got(doubling(table(spark, rows), distinct, tail=tail, metrics=m)) == walk(rows)
    assert ("finished_in_one_task" in m.more) == (tail > 0)
    for s in (Strategy.REDUCED, Strategy.DOUBLING, Strategy.HIGH_DEGREE):
        assert got(rank(table(spark, [(i, n, int(i != n)) for i, n, _ in chains]), s, tail=tail)) == walk([(i, n, int(i != n)) for i, n, _ in chains])
    with pytest.raises(Exception, match="cycle"):
        doubling(table(spark, [(1, 2, 1), (2, 3, 1), (3, 1, 1), (4, 4, 0)]), tail=tail).collect()
    with pytest.raises(Exception, match="is no id"):
        doubling(table(spark, [(1, 2, 1), (3, 3, 0)]), tail=tail).collect()
    with pytest.raises(StructureError, match="repeated"):
        doubling(table(spark, [(1, 2, 1), (2, 3, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1), (5, 5, 0)]), tail=0).collect()


def test_options(spark):
    rows = random_lists(150, 13)
    own = table(spark, rows)
    for strategy, options in {"ruling-set": {"every": 3, "rounds": 2, "levels": 2, "block_rows": 20}, "ruling-set-inverted": {"rounds": 3}, "forest-ruling-set": {"levels": 3, "every": 2, "base": "distinct"}, "contracted": {"block_rows": 30, "base": "ruling-set"}, "euler-tour": {"degree": 2, "base": "both-ways"}, "gather": {"most_rows": 200}, "ruling-set ": {"ruler": "dehne", "factor": 0.5, "rounds": 5}}.items():
        strategy = strategy.strip()
        lists = [(i, n, int(i != n)) for i, n, _ in rows] if strategy == "euler-tour" else rows
        assert got(rank(table(spark, lists), strategy, **options)) == walk(lists), strategy
    with pytest.raises(ValueError, match="no option every"):
        rank(own, "doubling", every=3)
    assert options_of("doubling") == ["tail"] and "levels" in options_of("ruling-set-inverted")


def test_choice_by_shape(spark):
    star = table(spark, [(0, 0, 0)] + [(i * 1000, 0, 1) for i in range(1, 1500)])
    assert choose(star, block_rows=10) is Strategy.DISTINCT
    low, high = estimate(10**9, 4), estimate(10**9, 10**9)
    assert low.ruling > low.doubling / 2 and high.ruling < high.doubling / 2


def test_proxies_come_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(forest, "HOT", 20)
    rows = [(0, 0, 0)] + [(i, 0 if i < 90 else i - 80, 1) for i in range(1, 120)]
    made = []
    plain = forest.with_proxies
    monkeypatch.setattr(forest, "with_proxies", lambda *a: made.append(a[1:]) or plain(*a))
    assert got(forest.euler_rank(table(spark, rows))) == walk(rows)
    assert made == [(20, 9)]


def test_dense_ids_of_uneven_ids(spark):
    own = sorted({*range(100), *(10**6 + i * i for i in range(300)), 10**17, 5 * 10**17})
    ids = spark.createDataFrame([(i,) for i in own], "id bigint")
    assert sorted(map(tuple, lookups.dense_ids(ids, 8).collect())) == [(i, k) for k, i in enumerate(own)]
    assert lookups.dense_ids(ids.limit(0)).count() == 0


@pytest.mark.parametrize("distinct", [False, True])
def test_elements_taken_out_and_put_back(spark, monkeypatch, distinct):
    monkeypatch.setattr(dbl, "LEAST", 40)
    monkeypatch.setattr(lookups, "FEW", 0)
    rows, m = [(i * 7, (i + 1) * 7 if i < 99 else i * 7, (i % 3) * int(i < 99)) for i in range(100)] + [(10_000 + i, (i % 2) * 7, 2) for i in range(40)], Metrics()
    assert got(doubling(table(spark, rows), distinct, tail=30, metrics=m)) == walk(rows)
    assert m.more["contracted_levels"] > 2


def test_pairs_in_a_circle_raise(spark):
    with pytest.raises(Exception, match="cycle"):
        doubling(table(spark, [(i, i ^ 1, 1) for i in range(8)] + [(9, 9, 0)] + [(10 + i, 9 + i, 1) for i in range(10)]), tail=12).collect()


def test_gather_beyond_one_task(spark, monkeypatch):
    monkeypatch.setattr(gather, "BLOCK_ROWS", 50)
    rows = random_forest(120, 14, (1, 2))
    assert got(gather.gather(table(spark, rows))) == walk(rows)
    with pytest.raises(Exception, match="is no id"):
        gather.gather(table(spark, [*rows, (100_000, 100_001, 1)])).collect()
