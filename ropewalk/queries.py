"""The library's queries over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as fn
from .operators import doubling as dbl
from .operators import forest, gather, graphs, lookups, predicates, prefix, ruling, stats
from .plans.ranking import rank
from .plans.tables import keep
from .schema import weighted
from .sources import generators as gen
from .sources import logs
from .sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


# --- the fixtures in SQL

CHAIN = "SELECT o_orderkey AS id, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), o_orderkey) AS succ, o_custkey AS g FROM orders"
CHAIN_RANK = """SELECT o_orderkey AS id, max(o_orderkey) OVER (PARTITION BY o_custkey) AS root,
  count(*) OVER (PARTITION BY o_custkey) - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders"""
GEO = """SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(r_regionkey AS BIGINT) AS succ FROM region
  UNION ALL SELECT 100 + n_nationkey, n_regionkey FROM nation
  UNION ALL SELECT 1000000 + s_suppkey, 100 + s_nationkey FROM supplier
  UNION ALL SELECT 10000000 + c_custkey, 100 + c_nationkey FROM customer"""
TREE = "SELECT o_orderkey AS id, CASE WHEN o_orderkey > 0 THEN ((o_orderkey * o_orderkey + 17) // 7 + o_custkey) % greatest(o_orderkey, 1) ELSE o_orderkey END AS succ FROM orders"
GRAPH = """SELECT DISTINCT o_custkey AS src, 10000000 + l_partkey AS dst, (o_custkey * 31 + l_partkey * 17) % 1009 AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  UNION SELECT DISTINCT 10000000 + l_partkey, o_custkey, (o_custkey * 31 + l_partkey * 17) % 1009 FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""
VERTICES = "SELECT c_custkey AS id FROM customer UNION ALL SELECT 10000000 + p_partkey FROM part"
KEYS = {
    "identity": "id",
    "permuted": "(id * 102947 + 17) % n",
    "partial": "CASE WHEN id % 10 = 0 THEN ((id // 10) * 7919 + 13) % ((n + 9) // 10) * 10 ELSE id END",
}


def path_sql(kind: str) -> str:
    return f"SELECT id, n, {KEYS[kind]} AS k FROM (SELECT o_orderkey AS id, count(*) OVER () AS n FROM orders)"


def path_rank_sql(kind: str, cut: int | None = None) -> str:
    end = "n - 1" if cut is None else f"least((k + {cut} - 1) // {cut} * {cut}, n - 1)"
    return f"WITH p AS ({path_sql(kind)}), e AS (SELECT id, k, {end} AS last FROM p) SELECT e.id AS id, p.id AS root, e.last - e.k AS rank FROM e JOIN p ON p.k = e.last"


def forest_rank_sql(forest_sql: str) -> str:
    return f"""WITH RECURSIVE f AS ({forest_sql}), r AS (SELECT id, id AS root, CAST(0 AS BIGINT) AS rank FROM f WHERE succ = id
  UNION ALL SELECT f.id, r.root, r.rank + 1 FROM f JOIN r ON f.succ = r.id WHERE f.id <> f.succ) SELECT * FROM r"""


# --- ranking, by strategy

QUERIES |= {
    "rank_orders_chain": lambda s, d: rank(t.orders_chain(s, d), "doubling", check=False, tail=0),
    "rank_orders_chain_weighted": lambda s, d: rank(t.orders_chain_weighted(s, d), "doubling", check=False, tail=0),
    "rank_events_chain": lambda s, d: rank(t.events_chain(s, d), "doubling", check=False),
    "rank_events_chain_tail": lambda s, d: rank(t.events_chain(s, d), "doubling", check=False, tail=3000),
    "rank_ruling_set_contracted": lambda s, d: rank(t.path(s, d, "partial"), "ruling-set", check=False, block_rows=4096, every=3, base="distinct"),
    "rank_forest_ruling_set_2level": lambda s, d: rank(t.recursive_tree(s, d), "forest-ruling-set", check=False, levels=2, rounds=3),
    "rank_path_permuted_rounds": lambda s, d: rank(t.path(s, d, "permuted"), "doubling", check=False, tail=0),
    "rank_validated": lambda s, d: rank(t.orders_chain(s, d), "auto", check=True),
    "rank_gather": lambda s, d: rank(t.orders_chain(s, d), "gather", check=False),
    "rank_distinct": lambda s, d: rank(t.orders_chain(s, d), "distinct", check=False, tail=0),
    "rank_reduced_volume": lambda s, d: rank(t.orders_chain(s, d), "reduced-volume", check=False, tail=0),
    "rank_bidirectional": lambda s, d: rank(t.orders_chain(s, d), "both-ways", check=False),
    "rank_bidirectional_weighted": lambda s, d: rank(t.orders_chain_weighted(s, d), "both-ways", check=False),
    "rank_async_alias": lambda s, d: rank(t.orders_chain(s, d), "async-doubling", check=False, tail=0),
    "rank_rma_alias": lambda s, d: rank(t.orders_chain(s, d), "rma-passive", check=False, tail=0),
    "rank_contracted": lambda s, d: gather.contracted(t.orders_chain(s, d), block_rows=4096, tail=0),
    "rank_contracted_weighted": lambda s, d: gather.contracted(t.orders_chain_weighted(s, d), block_rows=4096),
    "rank_ruling_set": lambda s, d: ruling.ruling_set(t.orders_chain(s, d)),
    "rank_ruling_set_2level": lambda s, d: ruling.ruling_set(t.events_chain(s, d), levels=2, rounds=4),
    "rank_ruling_set_gather": lambda s, d: ruling.ruling_set(t.orders_chain(s, d), base=gather.gather),
    "rank_ruling_post_invert": lambda s, d: ruling.ruling_set_inverted(t.orders_chain_weighted(s, d), rounds=4),
    "rank_path": lambda s, d: gather.contracted(t.path(s, d), block_rows=4096),
    "rank_path_permuted": lambda s, d: rank(t.path(s, d, "permuted"), "doubling", check=False),
    "rank_path_partial": lambda s, d: gather.contracted(t.path(s, d, "partial"), block_rows=4096),
    "rank_path_broken": lambda s, d: rank(t.path(s, d, "permuted", cut=100), "doubling", check=False, tail=0),
    "rank_path_permuted_gather": lambda s, d: rank(t.path(s, d, "permuted"), "gather", check=False),
    "rank_geo_forest": lambda s, d: rank(t.geography(s, d), "distinct", check=False),
    "rank_recursive_tree": lambda s, d: rank(t.recursive_tree(s, d), "doubling", check=False, tail=0),
    "rank_recursive_tree_contracted": lambda s, d: gather.contracted(t.recursive_tree(s, d), block_rows=4096),
    "rank_star": lambda s, d: rank(gen.star(t.numbered_orders(s, d)), "distinct", check=False, tail=0),
    "rank_stars": lambda s, d: rank(gen.stars(t.numbered_orders(s, d), 10), "distinct", check=False, tail=0),
    "rank_tailed_star": lambda s, d: gather.contracted(gen.tailed_star(t.numbered_orders(s, d)), block_rows=4096),
    "rank_caterpillar": lambda s, d: gather.contracted(gen.caterpillar(t.numbered_orders(s, d)), block_rows=4096),
    "rank_high_degree": lambda s, d: rank(t.geography(s, d), "high-degree", check=False, tail=0),
    "rank_forest_ruling_set": lambda s, d: ruling.forest_ruling_set(t.recursive_tree(s, d)),
    "rank_geo_ruling_set": lambda s, d: ruling.forest_ruling_set(t.geography(s, d), rule=F.col("id") % 4 == 0),
    "rank_euler_tour": lambda s, d: rank(t.geography(s, d), "euler-tour", check=False),
    "rank_euler_tour_gather": lambda s, d: forest.euler_rank(t.recursive_tree(s, d), rank=gather.gather),
    "rank_euler_tour_ruling_set": lambda s, d: forest.euler_rank(t.geography(s, d), rank=ruling.ruling_set),
    "rank_euler_tour_proxies": lambda s, d: forest.euler_rank(t.geography(s, d), degree=16, rank=gather.gather),
}
_STEPS = "SELECT o_orderkey AS id, max(o_orderkey) OVER (PARTITION BY o_custkey) AS root, max(o_orderkey) OVER (PARTITION BY o_custkey) - o_orderkey AS rank FROM orders"
_EVENTS = CHAIN_RANK.replace("o_orderkey", "event_id").replace("o_custkey", "user_id").replace("orders", "events")
SQL |= dict.fromkeys("rank_orders_chain rank_validated rank_gather rank_distinct rank_reduced_volume rank_bidirectional rank_async_alias rank_rma_alias rank_contracted rank_ruling_set rank_ruling_set_gather".split(), CHAIN_RANK)
SQL |= dict.fromkeys("rank_orders_chain_weighted rank_bidirectional_weighted rank_contracted_weighted rank_ruling_post_invert".split(), _STEPS)
SQL |= dict.fromkeys("rank_events_chain rank_events_chain_tail rank_ruling_set_2level".split(), _EVENTS)
SQL |= {"rank_path": path_rank_sql("identity"), "rank_path_permuted": path_rank_sql("permuted"), "rank_path_permuted_gather": path_rank_sql("permuted"), "rank_path_permuted_rounds": path_rank_sql("permuted"), "rank_path_partial": path_rank_sql("partial"), "rank_ruling_set_contracted": path_rank_sql("partial"), "rank_path_broken": path_rank_sql("permuted", 100)}
SQL |= dict.fromkeys("rank_geo_forest rank_high_degree rank_geo_ruling_set rank_euler_tour rank_euler_tour_ruling_set rank_euler_tour_proxies".split(), forest_rank_sql(GEO))
SQL |= dict.fromkeys("rank_recursive_tree rank_recursive_tree_contracted rank_forest_ruling_set rank_forest_ruling_set_2level rank_euler_tour_gather".split(), forest_rank_sql(TREE))
SQL |= {
    "rank_star": "SELECT o_orderkey AS id, CAST(0 AS BIGINT) AS root, CAST(o_orderkey > 0 AS BIGINT) AS rank FROM orders",
    "rank_stars": "SELECT o_orderkey AS id, o_orderkey % 10 AS root, CAST(o_orderkey >= 10 AS BIGINT) AS rank FROM orders",
    "rank_tailed_star": "SELECT o_orderkey AS id, CAST(0 AS BIGINT) AS root, least(o_orderkey, count(*) OVER () // 2) AS rank FROM orders",
    "rank_caterpillar": "SELECT o_orderkey AS id, CAST(0 AS BIGINT) AS root, o_orderkey // 2 + o_orderkey % 2 AS rank FROM orders",
}


# --- states, predicates, lists


@query(f"SELECT id, succ AS root, CAST(id <> succ AS BIGINT) AS rank, id = succ AS done FROM ({CHAIN})")
def init_state(s: SparkSession, d: str) -> DataFrame:
    return predicates.init_state(t.orders_chain(s, d))


@query(f"SELECT id FROM ({CHAIN}) WHERE id = succ")
def roots(s: SparkSession, d: str) -> DataFrame:
    return predicates.roots(t.orders_chain(s, d))


@query(f"SELECT id FROM ({CHAIN}) WHERE id <> succ")
def active_vertices(s: SparkSession, d: str) -> DataFrame:
    return predicates.active(t.orders_chain(s, d))


@query(f"WITH f AS ({GEO}) SELECT id FROM f WHERE id NOT IN (SELECT succ FROM f WHERE succ <> id)")
def leaves(s: SparkSession, d: str) -> DataFrame:
    return predicates.leaves(t.geography(s, d))


@query(f"WITH f AS ({CHAIN}) SELECT id FROM f WHERE id <> succ AND id NOT IN (SELECT succ FROM f WHERE succ <> id)")
def leaves_proper(s: SparkSession, d: str) -> DataFrame:
    return predicates.leaves(t.orders_chain(s, d), proper_only=True)


@query(f"WITH f AS ({GEO}) SELECT a.id, count(b.id) AS degree FROM f a LEFT JOIN f b ON b.succ = a.id AND b.id <> b.succ GROUP BY a.id")
def in_degrees(s: SparkSession, d: str) -> DataFrame:
    return predicates.in_degrees(t.geography(s, d))


_LIST = "SELECT count(*) = 0 AS is_list, count(*) AS branchings FROM (SELECT succ FROM ({}) WHERE id <> succ GROUP BY succ HAVING count(*) > 1)"


@query(_LIST.format(CHAIN))
def is_list(s: SparkSession, d: str) -> DataFrame:
    return predicates.list_check(t.orders_chain(s, d))


@query(_LIST.format(GEO))
def is_list_forest(s: SparkSession, d: str) -> DataFrame:
    return predicates.list_check(t.geography(s, d))


@query("SELECT o_orderkey AS id, coalesce(lag(o_orderkey) OVER w, o_orderkey) AS succ, coalesce(o_orderkey - lag(o_orderkey) OVER w, 0) AS weight FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def reverse_list(s: SparkSession, d: str) -> DataFrame:
    return predicates.reverse_list(t.orders_chain_weighted(s, d))


@query("SELECT max(o_orderkey) AS root, string_agg(CAST(o_orderkey AS VARCHAR), ' -> ' ORDER BY o_orderkey) AS trace FROM orders GROUP BY o_custkey")
def trace_lists(s: SparkSession, d: str) -> DataFrame:
    return stats.traces(rank(t.orders_chain(s, d), "auto", check=False))


# --- lookups, packing, sets


@query(f"WITH f AS ({GEO}) SELECT a.id, a.succ AS parent, b.succ AS grandparent FROM f a JOIN f b ON b.id = a.succ")
def request_reply(s: SparkSession, d: str) -> DataFrame:
    own = t.geography(s, d)
    return lookups.ask(own.select("id", F.col("succ").alias("parent")), own.withColumnRenamed("succ", "grandparent"), "parent").select("id", "parent", "grandparent")


@query(SQL["request_reply"])
def request_reply_distinct(s: SparkSession, d: str) -> DataFrame:
    own = t.geography(s, d)
    return lookups.ask(own.select("id", F.col("succ").alias("parent")), own.withColumnRenamed("succ", "grandparent"), "parent", distinct_first=True).select("id", "parent", "grandparent")


@query(f"SELECT dst AS id, count(*) AS n, max(c_nationkey) AS largest FROM ({GRAPH}) JOIN customer ON src = c_custkey GROUP BY dst")
def neighbour_values(s: SparkSession, d: str) -> DataFrame:
    edges, _ = t.purchases(s, d)
    values = t.read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("value"))
    return lookups.neighbour_values(edges, values).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("largest"))


@query("SELECT o_orderkey * 7 + 3 AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS dense FROM orders WHERE o_orderkey % 3 = 0")
def dense_ids(s: SparkSession, d: str) -> DataFrame:
    return lookups.dense_ids(t.read(s, d, "orders").filter("o_orderkey % 3 = 0").select((F.col("o_orderkey") * 7 + 3).alias("id")))


_PACK = f"WITH f AS ({CHAIN}), a AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS dense FROM f WHERE id % 3 <> 0)"


@query(_PACK + " SELECT a.dense AS id, coalesce(b.dense, a.dense) AS succ, CAST(b.dense IS NOT NULL AND b.dense <> a.dense AS BIGINT) AS weight FROM a LEFT JOIN a b ON b.id = a.succ")
def pack_active(s: SparkSession, d: str) -> DataFrame:
    own = weighted(t.orders_chain(s, d))
    return lookups.pack(own, own.filter("id % 3 != 0").select("id"))[0]


@query(
    f"""WITH f AS ({CHAIN}), i AS (SELECT *, count(*) FILTER (WHERE id % 3 = 0) OVER (PARTITION BY g ORDER BY id) AS run FROM f)
SELECT id, max(id) OVER (PARTITION BY g, run) AS root, count(*) OVER (PARTITION BY g, run) - row_number() OVER (PARTITION BY g, run ORDER BY id) AS rank FROM i WHERE id % 3 <> 0"""
)
def unpack_roots(s: SparkSession, d: str) -> DataFrame:
    own = keep(weighted(t.orders_chain(s, d)))
    packed, names = lookups.pack(own, own.filter("id % 3 != 0").select("id"))
    return lookups.unpack(dbl.doubling(keep(packed)), names)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def append_lists(s: SparkSession, d: str) -> DataFrame:
    own = t.numbered_orders(s, d).select("id")
    return lookups.append(own.filter("id % 4 = 0"), own.filter("id % 5 = 0"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 2 = 0)")
def difference(s: SparkSession, d: str) -> DataFrame:
    return lookups.without(t.numbered_orders(s, d).select("id"), t.read(s, d, "lineitem").filter("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("id")))


_RANGES = "SELECT o_orderkey // {0} AS part, min(o_orderkey) // {0} * {0} AS low, least(min(o_orderkey) // {0} * {0} + {0}, max(max(o_orderkey)) OVER () + 1) AS high FROM orders GROUP BY o_orderkey // {0}"


@query(f"WITH a AS ({_RANGES.format(100)}), b AS ({_RANGES.format(70)}) SELECT a.part AS l, b.part AS r, greatest(a.low, b.low) AS low, least(a.high, b.high) AS high FROM a JOIN b ON a.low < b.high AND b.low < a.high")
def range_overlaps(s: SparkSession, d: str) -> DataFrame:
    n = t.numbered_orders(s, d)

    def ranges(k: int) -> DataFrame:
        part = F.floor(F.col("id") / k).cast("long")
        return n.groupBy(part.alias("part")).agg(F.max("n").alias("n")).select("part", (F.col("part") * k).alias("low"), F.least(F.col("part") * k + k, F.col("n")).alias("high"))

    return lookups.overlaps(ranges(100), ranges(70))


# --- scans


_COUNTS = "SELECT c_nationkey AS part, count(*) AS n FROM customer GROUP BY c_nationkey"


def _counts(s: SparkSession, d: str) -> DataFrame:
    return t.read(s, d, "customer").groupBy(F.col("c_nationkey").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT part, n, CAST(sum(n) OVER (ORDER BY part) - n AS BIGINT) AS \"offset\" FROM ({_COUNTS})")
def partition_offsets(s: SparkSession, d: str) -> DataFrame:
    return prefix.exclusive_scan(_counts(s, d), "part", "n")


@query(f"SELECT part, n, CAST(sum(n) OVER (ORDER BY part) AS BIGINT) AS upto FROM ({_COUNTS})")
def inclusive_offsets(s: SparkSession, d: str) -> DataFrame:
    return prefix.inclusive_scan(_counts(s, d), "part", "n")


@query(f"SELECT part, n, \"offset\", lead(\"offset\") OVER (ORDER BY part) - \"offset\" AS size FROM ({SQL['partition_offsets']})")
def offset_differences(s: SparkSession, d: str) -> DataFrame:
    return prefix.differences(partition_offsets(s, d), "part", "offset")


@query(
    """SELECT c_nationkey AS g, c_custkey AS id, coalesce(lag(c_custkey) OVER w, max(c_custkey) OVER (PARTITION BY c_nationkey)) AS before,
  coalesce(lead(c_custkey) OVER w, min(c_custkey) OVER (PARTITION BY c_nationkey)) AS "after" FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)"""
)
def circle_neighbours(s: SparkSession, d: str) -> DataFrame:
    return prefix.circle(t.read(s, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id")), "g", "id")


@query("SELECT o_orderkey AS id FROM orders ORDER BY (o_orderkey * 7919) % 10007, o_orderkey LIMIT 100")
def sample_by_key(s: SparkSession, d: str) -> DataFrame:
    return prefix.sample_by_key(t.numbered_orders(s, d).select("id"), (F.col("id") * 7919) % 10007, 100)


@query("SELECT min(o_orderkey) AS id FROM orders WHERE o_orderkey >= 10 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 < 5)")
def first_unvisited(s: SparkSession, d: str) -> DataFrame:
    own = t.numbered_orders(s, d).select("id")
    return prefix.first_unvisited(own, own.filter("id % 7 < 5"), 10)


@query("SELECT CAST(min(n) AS BIGINT) AS min_size, CAST(max(n) AS BIGINT) AS max_size, CAST(sum(n) AS BIGINT) AS total_size FROM (" + _COUNTS + ")")
def size_stats(s: SparkSession, d: str) -> DataFrame:
    return prefix.size_stats(_counts(s, d))


# --- ruling-set parts

_RULED = f"WITH p AS ({path_sql('permuted')}), q AS (SELECT id, k, n, k = 0 OR (id % 4 = 0 AND k < n - 1) AS ruler FROM p), l AS (SELECT *, max(CASE WHEN ruler THEN k END) OVER (ORDER BY k) AS rk FROM q)"


def _rulers(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = keep(weighted(t.path(s, d, "permuted")))
    return own, keep(ruling.rulers(own, F.col("id") % 4 == 0))


@query(_RULED + " SELECT id FROM l WHERE ruler")
def ruler_sample(s: SparkSession, d: str) -> DataFrame:
    return _rulers(s, d)[1]


@query(_RULED + " SELECT l.id, r.id AS ruler, l.k - l.rk AS dist FROM l JOIN p r ON r.k = l.rk WHERE NOT l.ruler AND l.k < l.n - 1")
def ruler_segments(s: SparkSession, d: str) -> DataFrame:
    return ruling.walk(*_rulers(s, d), rounds=None)[0]


@query(_RULED + " SELECT id FROM l WHERE NOT ruler AND k < n - 1 AND k - rk > 2")
def unreached_nodes(s: SparkSession, d: str) -> DataFrame:
    own, chosen = _rulers(s, d)
    return ruling.unreached(own, chosen, ruling.walk(own, chosen, rounds=2)[0])


@query(
    _RULED
    + """ SELECT count(*) FILTER (WHERE ruler) AS num_rulers, CAST(1 AS BIGINT) AS num_leaves, count(*) FILTER (WHERE NOT ruler AND k < n - 1 AND k - rk <= 2) AS num_reached,
  count(*) FILTER (WHERE NOT ruler AND k < n - 1 AND k - rk > 2) AS num_unreached, count(*) FILTER (WHERE ruler OR k = n - 1 OR k - rk > 2) AS small, CAST(2 AS BIGINT) AS rounds FROM l"""
)
def walk_stats(s: SparkSession, d: str) -> DataFrame:
    return ruling.walk_stats(*_rulers(s, d), rounds=2)


@query(
    _RULED
    + """, g AS (SELECT rk, count(*) FILTER (WHERE NOT ruler AND k < n - 1) + 1 AS m FROM l GROUP BY rk)
SELECT count(*) AS num_links, min(m) AS min_segment, max(m) AS max_segment, avg(m) AS avg_segment, (SELECT count(*) FROM l WHERE ruler) AS num_rulers FROM g"""
)
def chain_length_stats(s: SparkSession, d: str) -> DataFrame:
    own, chosen = _rulers(s, d)
    reached, links = ruling.walk(own, chosen, rounds=None)
    return ruling.chain_stats(reached, links.filter("id != succ"), chosen)


_RATES = {"dehne": "n / (p * p)", "heuristic": "0.05 * n", "sanders": "sqrt(n) * p / ln(n)", "ultimate": "sqrt(n) * p", "ultimate-sanders": "sqrt(n * pow(p, 2)) / log2(p)", "limit-rounds": "n / 100"}


@query("SELECT strategy, n, round(least(1.0, greatest(1.0 / n, v / n)), 12) AS rate FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS strategy, CAST(n AS BIGINT) AS n, {v} AS v FROM (SELECT CAST(count(*) AS DOUBLE) AS n, 8.0 AS p FROM orders)" for k, v in _RATES.items()) + ")")
def ruler_counts(s: SparkSession, d: str) -> DataFrame:
    n = t.read(s, d, "orders").count()
    rows = [(k, n, round(fn.ruler_rate(k, n, 8, 0.05 if k == "heuristic" else 1.0), 12)) for k in _RATES]
    return s.createDataFrame(rows, "strategy string, n bigint, rate double")


@query("SELECT id, mark, mark & 4611686018427387903 AS plain, (owner << 44) | id AS packed, id AS idx, owner FROM (SELECT o_orderkey AS id, o_orderkey | (CAST(1 AS BIGINT) << 62) AS mark, o_custkey % 64 AS owner FROM orders)")
def packed_ids(s: SparkSession, d: str) -> DataFrame:
    own = t.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), fn.flagged(F.col("o_orderkey")).alias("mark"), fn.packed(F.col("o_orderkey"), F.col("o_custkey") % 64).alias("packed"))
    return own.select("id", "mark", fn.unflagged(F.col("mark")).alias("plain"), "packed", fn.packed_index(F.col("packed")).alias("idx"), fn.packed_owner(F.col("packed")).alias("owner"))


# --- trees and graphs

_TOUR = f"""WITH f AS ({GEO}), near AS (SELECT succ AS v, id AS u, FALSE AS above FROM f WHERE id <> succ UNION ALL SELECT id, succ, TRUE FROM f WHERE id <> succ),
w AS (SELECT *, lead(u) OVER o AS nu, lead(above) OVER o AS na, first_value(u) OVER o AS fu, first_value(above) OVER o AS fa, bool_or(above) OVER (PARTITION BY v) AS inn FROM near WINDOW o AS (PARTITION BY v ORDER BY u)),
s AS (SELECT *, CASE WHEN nu IS NOT NULL THEN nu WHEN inn THEN fu END AS su, CASE WHEN nu IS NOT NULL THEN na WHEN inn THEN fa END AS sa FROM w),
tour AS (SELECT CASE WHEN above THEN 2 * v + 1 ELSE 2 * u END AS id, CASE WHEN su IS NULL OR sa THEN 2 * v ELSE 2 * su + 1 END AS succ,
  CAST(CASE WHEN above THEN -1 ELSE 1 END AS BIGINT) AS weight, NOT above AS is_up, u AS v, v AS u FROM s
  UNION ALL SELECT 2 * id, 2 * id, 0, FALSE, id, id FROM f WHERE id = succ)"""


@query(_TOUR + " SELECT * FROM tour")
def euler_tour_elements(s: SparkSession, d: str) -> DataFrame:
    return forest.euler_tour(t.geography(s, d))


@query(_TOUR + " SELECT a.id, a.v, a.u, b.v AS next_v, b.u AS next_u FROM tour a JOIN tour b ON b.id = a.succ")
def euler_tour_edges(s: SparkSession, d: str) -> DataFrame:
    return forest.tour_edges(keep(forest.euler_tour(t.geography(s, d))))


@query(_TOUR.replace("WITH f", "WITH RECURSIVE f") + ", r AS (SELECT id, id AS root, CAST(0 AS BIGINT) AS rank FROM tour WHERE id = succ UNION ALL SELECT tour.id, r.root, r.rank + 1 FROM tour JOIN r ON tour.succ = r.id WHERE tour.id <> tour.succ) SELECT * FROM r")
def euler_tour_positions(s: SparkSession, d: str) -> DataFrame:
    return forest.tour_positions(t.geography(s, d))


@query(f"WITH f AS ({GEO}) SELECT succ AS src, id AS dst FROM f WHERE id <> succ UNION ALL SELECT id, succ FROM f WHERE id <> succ")
def reversed_tree(s: SparkSession, d: str) -> DataFrame:
    return forest.reversed_tree(t.geography(s, d), back_edges=True)


@query(f"SELECT id, count(src) AS degree FROM ({VERTICES}) LEFT JOIN ({GRAPH}) ON src = id GROUP BY id")
def graph_degree(s: SparkSession, d: str) -> DataFrame:
    return graphs.degrees(*t.purchases(s, d))


@query(f"SELECT (SELECT count(*) FROM ({VERTICES})) AS num_vertices, (SELECT count(*) FROM ({GRAPH})) AS num_edges")
def graph_counts(s: SparkSession, d: str) -> DataFrame:
    return graphs.counts(*t.purchases(s, d))


@query(f"SELECT src AS id, array_to_string(list(dst ORDER BY dst), ' ') AS neighbours FROM ({GRAPH}) GROUP BY src")
def adjacency(s: SparkSession, d: str) -> DataFrame:
    return graphs.neighbours(t.purchases(s, d)[0]).select("id", F.array_join(F.col("neighbours").cast("array<string>"), " ").alias("neighbours"))


@query(f"SELECT id, coalesce(max(dst), id) AS succ FROM ({VERTICES}) LEFT JOIN ({GRAPH}) ON src = id GROUP BY id")
def edges_to_succ(s: SparkSession, d: str) -> DataFrame:
    return graphs.edges_to_succ(*t.purchases(s, d))


def bfs_sql(starts: str, where: str = "TRUE", levels: int = 8) -> str:
    """Level by level, written out: correct where no vertex is farther than levels."""
    out = f"WITH e AS MATERIALIZED (SELECT * FROM ({GRAPH}) WHERE {where}), l0 AS MATERIALIZED ({starts})"
    for i in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{j}" for j in range(i))
        out += f", l{i} AS MATERIALIZED (SELECT dst AS id, min(src) AS parent, CAST({i} AS BIGINT) AS level FROM e JOIN l{i - 1} ON src = id WHERE dst NOT IN ({seen}) GROUP BY dst)"
    return out + ", b AS (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(levels + 1)) + ")"


_START = "SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS parent, CAST(0 AS BIGINT) AS level"


@query(bfs_sql(_START) + " SELECT * FROM b")
def bfs_levels(s: SparkSession, d: str) -> DataFrame:
    edges, vertices = t.purchases(s, d)
    return graphs.bfs(keep(edges), vertices.filter("id = 0"))


@query(bfs_sql(_START, "weight % 50 < 9", 12) + " SELECT * FROM b WHERE level <= 5")
def bfs_predicate(s: SparkSession, d: str) -> DataFrame:
    edges, vertices = t.purchases(s, d)
    return graphs.bfs(keep(edges), vertices.filter("id = 0"), F.col("weight") % 50 < 9, max_levels=5)


def forest_sql(rounds: int = 8) -> str:
    out = f"WITH e AS MATERIALIZED ({GRAPH}), v AS ({VERTICES}), m0 AS (SELECT id, id AS c FROM v)"
    for i in range(1, rounds + 1):
        out += f", m{i} AS MATERIALIZED (SELECT m.id, least(m.c, coalesce(min(o.c), m.c)) AS c FROM m{i - 1} m LEFT JOIN e ON e.src = m.id LEFT JOIN m{i - 1} o ON o.id = e.dst GROUP BY m.id, m.c)"
    starts = f"SELECT id, id AS parent, CAST(0 AS BIGINT) AS level FROM m{rounds} WHERE id = c"
    return out + ", " + bfs_sql(starts).removeprefix(f"WITH e AS MATERIALIZED (SELECT * FROM ({GRAPH}) WHERE TRUE), ") + " SELECT id, parent AS succ FROM b"


@query(forest_sql())
def bfs_forest(s: SparkSession, d: str) -> DataFrame:
    edges, vertices = t.purchases(s, d)
    return graphs.bfs_forest(edges, vertices)


@query(
    f"""WITH e AS ({GRAPH}), p AS (SELECT src AS id, dst AS too FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight, dst) AS k FROM e) WHERE k = 1)
SELECT v.id, CASE WHEN p.too IS NULL OR (q.too = v.id AND v.id < p.too) THEN v.id ELSE p.too END AS succ FROM ({VERTICES}) v LEFT JOIN p ON p.id = v.id LEFT JOIN p q ON q.id = p.too"""
)
def lightest_edge_forest(s: SparkSession, d: str) -> DataFrame:
    return graphs.lightest_edge_forest(*t.purchases(s, d))


# --- statistics and checks

_RANKED = f"WITH r AS ({CHAIN_RANK})"


def _ranked(s: SparkSession, d: str) -> DataFrame:
    return keep(rank(t.orders_chain(s, d), "auto", check=False))


@query(_RANKED + " SELECT count(*) FILTER (WHERE root = id) AS num_trees, max(rank) AS max_rank, avg(rank) AS avg_rank FROM r")
def basic_stats(s: SparkSession, d: str) -> DataFrame:
    return stats.stats(_ranked(s, d), "basic")


_TREES = "SELECT root, count(*) AS size, max(rank) AS max_rank, CAST(sum(rank) AS BIGINT) AS rank_sum FROM r GROUP BY root"


@query(_RANKED + " " + _TREES)
def tree_stats(s: SparkSession, d: str) -> DataFrame:
    return stats.tree_stats(_ranked(s, d))


@query(_RANKED + f" SELECT size, max_rank AS max_depth, count(*) AS trees FROM ({_TREES}) GROUP BY ALL")
def size_histogram(s: SparkSession, d: str) -> DataFrame:
    return stats.size_histogram(_ranked(s, d))


_EXTENSIVE = f"""{_RANKED}, t AS ({_TREES})
SELECT count(*) AS num_trees, count(*) FILTER (WHERE size > 1) AS num_nontrivial,{{}} coalesce(max(size), 0) AS max_size,
  coalesce(sum(size) / nullif(count(*), 0), 0) AS avg_size, coalesce(sum(size) FILTER (WHERE size > 1) / nullif(count(*) FILTER (WHERE size > 1), 0), 0) AS nontrivial_avg_size,
  coalesce(sum(rank_sum) FILTER (WHERE size > 1) / nullif(sum(size) FILTER (WHERE size > 1), 0), 0) AS nontrivial_avg_rank FROM t"""


@query(_EXTENSIVE.format(" CAST(coalesce(sum(size) FILTER (WHERE size > 1), 0) AS BIGINT) AS nontrivial_size_sum, CAST(coalesce(sum(rank_sum) FILTER (WHERE size > 1), 0) AS BIGINT) AS nontrivial_rank_sum,"))
def extensive_stats(s: SparkSession, d: str) -> DataFrame:
    return stats.stats(_ranked(s, d), "extensive")


@query(_EXTENSIVE.format(""))
def extensive_stats_reduced(s: SparkSession, d: str) -> DataFrame:
    return stats.stats(_ranked(s, d), "extensive-reduced-output")


@query("SELECT CAST(0 AS BIGINT) AS violations")
def verify_recurrence(s: SparkSession, d: str) -> DataFrame:
    own = t.recursive_tree(s, d)
    return stats.violations(own, rank(own, "doubling", check=False)).agg(F.count(F.lit(1)).alias("violations"))


@query("SELECT CAST(0 AS BIGINT) AS mismatches")
def verify_against_gather(s: SparkSession, d: str) -> DataFrame:
    own = t.geography(s, d)
    return stats.mismatches(rank(own, "distinct", check=False), rank(own, "gather", check=False)).agg(F.count(F.lit(1)).alias("mismatches"))


@query("SELECT CAST(1 AS BIGINT) AS num_trees, CAST(4999 AS BIGINT) AS max_rank, CAST(2499.5 AS DOUBLE) AS avg_rank")
def generated_path(s: SparkSession, d: str) -> DataFrame:
    return stats.basic_stats(rank(gen.from_spec(s, "type=path;n=5000;permute=true"), "gather"))


@query("SELECT CAST(0 AS BIGINT) AS violations")
def generated_bfs_forest(s: SparkSession, d: str) -> DataFrame:
    own = keep(gen.from_spec(s, "type=gnm-undirected;n=2000;m=3000", "bfs"))
    return stats.violations(own, rank(own, "gather")).agg(F.count(F.lit(1)).alias("violations"))


@query("SELECT CAST(0 AS BIGINT) AS violations")
def generated_tour(s: SparkSession, d: str) -> DataFrame:
    own = keep(gen.from_spec(s, "type=rgg2d;n=1500", "eulertour"))
    return stats.violations(own, rank(own, "gather")).agg(F.count(F.lit(1)).alias("violations"))


# --- how rows lie


@query("SELECT CAST(count(*) AS BIGINT) AS total_size, true AS even FROM orders")
def rebalanced_sizes(s: SparkSession, d: str) -> DataFrame:
    """Of all rows in one partition, dealt anew: how many there are, and that no partition holds twice its share."""
    n = t.numbered_orders(s, d).select("id")
    sizes = prefix.size_stats(prefix.partition_sizes(prefix.rebalance(n.coalesce(1), 8)))
    return sizes.select("total_size", (F.col("max_size") <= 2 * F.ceil(F.col("total_size") / 8)).alias("even"))


# --- tables out of reports: each order is a run with a report


def _reports(s: SparkSession, d: str) -> DataFrame:
    own = t.read(s, d, "orders").select("o_orderkey", "o_custkey")
    config = F.struct((F.col("o_orderkey") % 4).alias("p"), F.concat(F.lit("type=path;n="), F.col("o_custkey") % 7).alias("input"))
    times = F.array(*((F.col("o_orderkey") % k).cast("double") for k in (10, 11, 13)))
    return own.select(F.concat(F.lit("f"), F.col("o_custkey") % 20).alias("file"), F.to_json(F.struct(config.alias("config"), times.alias("times"))).alias("report"))


def _runs(s: SparkSession, d: str) -> DataFrame:
    found = logs.extract(_reports(s, d), {"p": "$.config.p", "input": "$.config.input"})
    return logs.options(found, "input_text", ["type", "n"]).select("file", "report", "p", "p_text", "type", "n")


_RUNS = "SELECT 'f' || (o_custkey % 20) AS file, CAST(o_orderkey % 4 AS DOUBLE) AS p, CAST(o_orderkey % 4 AS VARCHAR) AS p_text, 'path' AS type, CAST(o_custkey % 7 AS VARCHAR) AS n, o_orderkey FROM orders"
_TIMES = f"SELECT file, p, type, n, 1 AS iteration, CAST(o_orderkey % 11 AS DOUBLE) AS t FROM ({_RUNS}) UNION ALL SELECT file, p, type, n, 2, CAST(o_orderkey % 13 AS DOUBLE) FROM ({_RUNS})"


@query(f"SELECT file, p, p_text, type, n FROM ({_RUNS})")
def report_fields(s: SparkSession, d: str) -> DataFrame:
    return _runs(s, d).drop("report")


def _times(s: SparkSession, d: str) -> DataFrame:
    return logs.warm(logs.iterations(_runs(s, d), {"t": "$.times"})).select("file", "p", "type", "n", "iteration", "t")


@query(_TIMES)
def report_iterations(s: SparkSession, d: str) -> DataFrame:
    return _times(s, d)


@query(f"SELECT n, count(*) AS nrows, string_agg(DISTINCT file, ',' ORDER BY file) AS files, avg(t) AS mean, min(t) AS least, max(t) AS largest FROM ({_TIMES}) GROUP BY n HAVING count(*) >= 2")
def report_summary(s: SparkSession, d: str) -> DataFrame:
    return logs.summary(_times(s, d), ["n"], "t", least=2)


@query(f"SELECT type, n, 't' AS variable, avg(t) AS value FROM ({_TIMES}) GROUP BY type, n UNION ALL SELECT type, n, 'p', avg(p) FROM ({_TIMES}) GROUP BY type, n")
def report_means_long(s: SparkSession, d: str) -> DataFrame:
    return logs.means_long(_times(s, d), ["t", "p"], drop=["file", "iteration"])


@query(f"SELECT label, code, count(*) AS nrows FROM (SELECT type || ' ' || n AS label, dense_rank() OVER (ORDER BY type || ' ' || n) AS code FROM ({_TIMES})) GROUP BY label, code")
def report_codes(s: SparkSession, d: str) -> DataFrame:
    rows, _ = logs.encoded(logs.labelled(_times(s, d), ["type", "n"]), "label")
    return rows.groupBy("label", F.col("code").cast("long").alias("code")).agg(F.count(F.lit(1)).alias("nrows"))


@query(f"SELECT file, n, CAST(NULL AS DOUBLE) AS t FROM ({_RUNS}) UNION ALL SELECT file, NULL, t FROM ({_TIMES})")
def report_combined(s: SparkSession, d: str) -> DataFrame:
    return logs.combined(_runs(s, d).select("file", "n"), _times(s, d).select("file", "t"))
