"""Every query of the library with its SQL, on the smallest tables."""

import os

import duckdb
import pytest
from ropewalk import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
QUICK = [q for q in queries.QUERIES if not q.startswith(("rank_", "generated_", "bfs_predicate"))] + ["rank_orders_chain", "rank_orders_chain_weighted", "rank_bidirectional_weighted", "rank_path_broken", "rank_geo_ruling_set", "rank_euler_tour_proxies", "rank_events_chain_tail", "rank_ruling_set_contracted", "rank_forest_ruling_set_2level", "rank_path_permuted"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_each_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", QUICK)
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    expected = duck.execute(queries.SQL[name])
    names = [d[0] for d in expected.description]
    assert cols == sorted(names)

    def tidy(v):
        return round(float(v), 9) if isinstance(v, float) else int(v) if hasattr(v, "__int__") and not isinstance(v, str) else v

    want = sorted(repr([tidy(r[names.index(c)]) for c in cols]) for r in expected.fetchall())
    assert sorted(repr([tidy(r[c]) for c in cols]) for r in df.collect()) == want
