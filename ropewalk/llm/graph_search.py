"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Vectors are dealt to shards by hash. A shard's nodes are its different directions; vectors of one direction are the
node's members. The graph grows in batches: a greedy beam search from the entry points proposes neighbours for each
new node, relaxed distance pruning keeps diverse ones among them, and the edges are added in reverse and pruned
again. Queries are searched in every shard with a beam, which each shard widens until its recall on the first queries
suffices; all members of the nodes found get their exact cosine in double precision, and the best of all shards stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash

#: Edges of a node, beams of building and searching (at first), relaxation, entry points.
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX, ENTRIES = 24, 40, 120, 1.2, 8
#: Vectors of a shard (about): as many shards as SHARDS, within these bounds of what a task holds.
SHARDS, LEAST_SHARD, MOST_SHARD = 256, 8192, 65536
#: A shard's beam grows until it finds this share of the true nearest of its first PROBES queries.
RECALL, PROBES = 0.97, 64
_AT_ONCE = 256
_CLOSE = 1e-12  # squared distance


class Graph:
    """Over unit vectors."""

    def __init__(self, units: np.ndarray, seed: int = 7):
        self.x = np.ascontiguousarray(units, np.float64)
        n = len(self.x)
        self.out = np.full((n, DEGREE), -1, np.int64)
        order = np.random.default_rng(seed).permutation(n)
        self.entries = order[:ENTRIES]
        done, size = 0, 1
        while done < n:
            self._insert(order[done : done + size], order[:done])
            done += size
            size = min(2 * size, _AT_ONCE)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Node ids (-1: none) and squared distances, nearest first, for each query."""
        b, n, every = len(q), len(self.x), np.arange(len(q))[:, None]
        seen = np.zeros((b, n + 1), bool)
        ids = np.tile(self.entries, (b, 1))
        seen[every, ids] = True
        dist = 2 - 2 * (q @ self.x[self.entries].T)
        open_ = np.ones(ids.shape, bool)
        while True:
            step = np.where(open_, dist, np.inf)
            pick = np.argpartition(step, min(3, step.shape[1] - 1), axis=1)[:, :4] if step.shape[1] > 4 else np.tile(np.arange(step.shape[1]), (b, 1))
            use = np.isfinite(np.take_along_axis(step, pick, 1))
            live = use.any(axis=1)
            if not live.any():
                order = np.argsort(dist, axis=1, kind="stable")
                return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
            np.put_along_axis(open_, pick, False, 1)
            rows = np.flatnonzero(live)
            nbr = self.out[np.take_along_axis(ids, pick, 1)[rows]]
            nbr[~use[rows]] = -1
            nbr = nbr.reshape(len(rows), -1)
            nbr[seen[rows[:, None], nbr]] = -1
            nbr = np.sort(nbr, axis=1)  # the same neighbour of two picks counts once
            nbr[:, 1:][nbr[:, 1:] == nbr[:, :-1]] = -1
            seen[rows[:, None], nbr] = True
            seen[:, n] = False
            new = np.full(nbr.shape, np.inf)
            r, c = np.nonzero(nbr >= 0)
            new[r, c] = 2 - 2 * np.einsum("ij,ij->i", self.x[nbr[r, c]], q[rows[r]])
            wide_i, wide_d, wide_o = (np.full((b, ids.shape[1] + nbr.shape[1]), f, t) for f, t in ((-1, np.int64), (np.inf, np.float64), (False, bool)))
            k = ids.shape[1]
            wide_i[:, :k], wide_d[:, :k], wide_o[:, :k] = ids, dist, open_
            wide_i[rows, k:], wide_d[rows, k:], wide_o[rows, k:] = nbr, new, nbr >= 0
            if wide_d.shape[1] > beam:
                keep = np.argpartition(wide_d, beam - 1, axis=1)[:, :beam]
                wide_i, wide_d, wide_o = (np.take_along_axis(a, keep, 1) for a in (wide_i, wide_d, wide_o))
            ids, dist, open_ = wide_i, wide_d, wide_o

    def _prune(self, node: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """DEGREE diverse ones of the candidates of each node (-1: none).

        Candidates so close that rounding decides are no evidence about each other: they stay, half of DEGREE at most.
        """
        cand = np.sort(np.where(cand == node[:, None], -1, cand), axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        v = self.x[cand]
        own = np.where(cand < 0, np.inf, 2 - 2 * np.einsum("bcd,bd->bc", v, self.x[node]))
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        out, row = np.full((len(node), DEGREE), -1, np.int64), np.arange(len(node))
        alive, close = own.copy(), own <= _CLOSE
        for k in range(DEGREE):
            if k == DEGREE // 2:
                alive[close] = np.inf
            best = alive.argmin(axis=1)
            ok = np.isfinite(alive[row, best])
            if not ok.any():
                break
            out[ok, k] = cand[row, best][ok]
            alive[(RELAX**2 * between[row, best] <= own) & ~close] = np.inf
            alive[row, best] = np.inf
        return out

    def _insert(self, new: np.ndarray, before: np.ndarray) -> None:
        if not len(before):
            return
        cand, dist = self.search(self.x[new], BUILD_BEAM)
        cand[~np.isfinite(dist)] = -1
        cand[~np.isin(cand, before)] = -1  # entry points are not in the graph before their turn
        if len(before) <= BUILD_BEAM:
            cand = np.tile(before, (len(new), 1))
        if len(new) > 1:  # those that come at the same time don't find each other
            near = self.x[new] @ self.x[new].T
            np.fill_diagonal(near, -np.inf)
            cand = np.concatenate((cand, new[np.argsort(-near, axis=1, kind="stable")[:, : min(DEGREE, len(new) - 1)]]), axis=1)
        self.out[new] = self._prune(new, cand)
        to, of = self.out[new].reshape(-1), np.repeat(new, DEGREE)
        to, of = to[to >= 0], of[to >= 0]
        near = np.einsum("ij,ij->i", self.x[to], self.x[of])
        order = np.lexsort((-near, to))
        to, of = to[order], of[order]
        first = np.concatenate(([0], np.flatnonzero(to[1:] != to[:-1]) + 1))
        place = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        width = min(int(place.max()) + 1, 2 * DEGREE)
        back = np.full((len(first), width), -1, np.int64)
        ok = place < width
        back[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(to))))[ok], place[ok]] = of[ok]
        nodes = to[first]
        wide = np.concatenate((self.out[nodes], back), axis=1)
        full = (wide >= 0).sum(axis=1) > DEGREE
        for i in range(0, full.sum(), _AT_ONCE):
            part = np.flatnonzero(full)[i : i + _AT_ONCE]
            self.out[nodes[part]] = self._prune(nodes[part], wide[part])
        some = np.flatnonzero(~full)
        self.out[nodes[some]] = -np.sort(-wide[some], axis=1)[:, :DEGREE]


def _valid(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _canonical(v: pa.Array) -> list[bytes]:
    """Each vector, scaled by a power of two to a largest component from a half to one: what differs by such a factor becomes equal."""
    flat, sizes = v.flatten().to_numpy(zero_copy_only=False) + 0.0, v.value_lengths().to_numpy(zero_copy_only=False)
    at = np.concatenate(([0], np.cumsum(sizes)))
    _, power = np.frexp(np.maximum.reduceat(np.abs(flat), at[:-1])) if len(sizes) else (None, np.zeros(0, np.int32))
    flat = np.ldexp(flat, -np.repeat(power, sizes)) + 0.0
    return [flat[s:e].tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def nearest(vectors: DataFrame, queries: Column, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where queries holds its top nearest others by cosine.

    All rows are indexed but those whose vector is null, zero, or holds a null or non-finite component, or whose id
    is null; they are no queries either. Vectors of different lengths never meet. Ties go to the smaller id. Vectors
    that are equal, or differ by a power of two, are one with their top + 1 smallest ids, all that a result can need,
    so large groups of them cost nothing; an id repeated with one vector counts once. An empty table gives an empty
    result. Scores are exact; which neighbours are found is approximate (see RECALL, and recall() to measure it)
    unless exact, where every query is multiplied with all vectors of every shard, a block at a time.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), queries.alias("asks")).filter(_valid(F.col("v")))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal vectors of a batch are one row with their smallest ids."""
        for b in batches:
            found: dict[bytes, list[int]] = {}
            for key, i in zip(_canonical(b.column("v")), b.column("id").to_pylist(), strict=True):
                found.setdefault(key, []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array([sorted(set(x))[: top + 1] for x in found.values()], pa.list_(pa.int64()))], ["v", "ids"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(_canonical(b.column("v")), pa.binary())], ["id", "v"])

    nodes = stash(rows.select("id", "v").mapInArrow(combine, "v binary, ids array<bigint>"))
    asked = stash(rows.filter("asks").select("id", "v").mapInArrow(packed, "id bigint, v binary").distinct())
    n = nodes.count()
    shards = max(1, -(-n // (shard or min(MOST_SHARD, max(LEAST_SHARD, n // SHARDS)))))
    dealt = nodes.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("query"), "v", "ids")
    each = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.col("id").alias("query"), "v", F.lit(None).cast("array<bigint>").alias("ids"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shard by shard: its nodes come first, then the queries, which need not fit into memory together."""
        shard_now, held, index = None, {}, None
        for b in batches:
            shards_, kinds = b.column("shard").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(shards_) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards_)], strict=True):
                if lo == hi:
                    continue
                if shards_[lo] != shard_now:
                    shard_now, held, index = shards_[lo], {}, None
                part = b.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    for v_, ids in zip(part.column("v").to_pylist(), part.column("ids").to_pylist(), strict=True):
                        held[v_] = sorted({*held.get(v_, ()), *ids})[: top + 1]
                    continue
                index = index or _Shard(held, exact)
                for i in range(0, len(part), _AT_ONCE):
                    few = part.slice(i, _AT_ONCE)
                    yield index.ask(few.column("query").to_pylist(), few.column("v").to_pylist(), top)

    found = dealt.union(each).repartition("shard").sortWithinPartitions("shard", "kind", "query").mapInArrow(find, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of the neighbours in true that are in found, both from nearest; 1 where true is empty."""
    hits = true.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    n, hit = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum("hit"), F.lit(0))).first()
    return hit / n if n else 1.0


class _Directions:
    """Vectors of one length: their nodes, one for each direction as floats tell it, and the members of each."""

    def __init__(self, vectors: list[bytes], names: list[list[int]], exact: bool):
        x = np.array([np.frombuffer(v) for v in vectors])
        self.units, self.names, self.exact, self.beam = x / np.linalg.norm(x, axis=1, keepdims=True), names, exact, None
        if not exact:
            key = (self.units.astype(np.float32) + np.float32(0)).view(np.dtype((np.void, 4 * x.shape[1])))[:, 0]
            _, first, node = np.unique(key, return_index=True, return_inverse=True)
            self.members = np.argsort(node, kind="stable")
            self.first = np.searchsorted(node[self.members], np.arange(len(first) + 1))
            self.graph = Graph(self.units[first])

    def found(self, q: np.ndarray, top: int) -> list[np.ndarray]:
        """For each query vectors among which its top nearest are, as far as found."""
        if self.exact:
            return [np.arange(len(self.units))] * len(q)
        n = len(self.graph.x)
        if self.beam is None:
            self.beam = min(n, SEARCH_BEAM)
            some = q[:PROBES]
            true = np.sort(self.graph.x @ some.T, axis=0)[-min(n, top) :].T  # a node for each of the nearest
            while self.beam < n and (self._nodes(some, true.shape[1], self.beam)[1][:, : true.shape[1]] <= 2 - 2 * true[:, ::-1] + 1e-9).mean() < RECALL:
                self.beam = min(n, self.beam * 3 // 2)
        ids, dist = self._nodes(q, top, self.beam)
        return [self._members_of(i[np.isfinite(d)]) for i, d in zip(ids, dist, strict=True)]

    def _nodes(self, q: np.ndarray, top: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the beam; wider where its last node is as near as those that count, so that ties are not cut."""
        ids, dist = self.graph.search(q, beam)
        n = len(self.graph.x)
        tied = np.flatnonzero(dist[:, -1] <= dist[:, min(top, dist.shape[1] - 1)] + 1e-12) if dist.shape[1] >= beam and beam < n else []
        if len(tied):
            more, far = self._nodes(q[tied], top, min(n, 2 * beam))
            wide = max(more.shape[1], ids.shape[1])
            ids, dist = (np.pad(a, ((0, 0), (0, wide - a.shape[1])), constant_values=f) for a, f in ((ids, -1), (dist, np.inf)))
            ids[tied, : more.shape[1]], dist[tied, : more.shape[1]] = more, far
        return ids, dist

    def _members_of(self, nodes: np.ndarray) -> np.ndarray:
        size = self.first[nodes + 1] - self.first[nodes]
        return self.members[np.repeat(self.first[nodes] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class _Shard:
    """The vectors of a shard by their length."""

    def __init__(self, held: dict[bytes, list[int]], exact: bool = False):
        self.by_size = {}
        for size in {len(v) for v in held}:
            own = sorted(v for v in held if len(v) == size)
            self.by_size[size] = _Directions(own, [held[v] for v in own], exact)

    def ask(self, ids: list[int], vectors: list[bytes], top: int) -> pa.RecordBatch:
        out: list[tuple[int, int, float]] = []
        for size in {len(v) for v in vectors} & self.by_size.keys():
            own = self.by_size[size]
            few = [k for k, v in enumerate(vectors) if len(v) == size]
            q = np.array([np.frombuffer(vectors[k]) for k in few])
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            for k, unit, at in zip(few, q, own.found(q, top), strict=True):
                score = np.einsum("ij,j->i", own.units[at], unit)
                if len(at) > top + 1:  # one of them may be the query itself
                    near = np.flatnonzero(score >= np.partition(score, -top - 1)[-top - 1])
                    at, score = at[near], score[near]
                hits = sorted((-s, i) for s, a in zip(score.tolist(), at.tolist(), strict=True) for i in own.names[a] if i != ids[k])[:top]
                out += [(ids[k], i, -s) for s, i in hits]
        return pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], ["query_id", "vec_id", "score"])


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nearest of embeddings for every vec_id divisible by 50; see there for nulls, ties and repeated rows."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


SQL: dict[str, str] = {}
QUERIES = {"op10_neighbours": op10_neighbours}
