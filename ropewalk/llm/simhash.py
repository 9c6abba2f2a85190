"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index for near ones, and their components.

Fingerprints within a few bits of each other are found in shards. 64 bits are cut into blocks, and each choice of
blocks that must agree is a table, so that any two near fingerprints meet in some shard (table, value of its
blocks). A shard with too many of them is cut again by blocks of its other bits. In a shard the distinct fingerprints are sorted by Gray rank, in which neighbours share long bit patterns;
runs of eight become nodes that hold the bits all their members share, and runs of eight nodes upper nodes. Two
nodes are compared by their shared bits alone; the differences found add up on the way down, and a pair of nodes
above the limit is pruned with everything under it. Pairs that must be within the limit are linked as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .common import attach, stash

SHINGLE, SEED, NEAR, FAN = 4, 42, 4, 8
MOST = 1 << 16  # fingerprints in a shard
_PIECE = 1 << 18  # shingles, or pairs of nodes, handled at once


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is set if over half of the shingles' XXH64 have it; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, _PIECE):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[i : i + _PIECE], ends[i : i + _PIECE], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint's 64 bits as a long. Null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps)], ["id", "fp"])

    return rows.mapInArrow(run, f"id {kind}, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of x among the codes of a Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _merge(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    while True:
        a, b = labels[u], labels[v]
        differ = a != b
        if not differ.any():
            return labels
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(nxt := labels[labels], labels):
            labels = nxt


class GrayIndex:
    """Over distinct fingerprints of one or more groups, in order of (group, Gray rank)."""

    def __init__(self, group: np.ndarray, fps: np.ndarray):
        self.order = np.lexsort((gray_rank(fps), group))
        self.fps, group = fps[self.order], group[self.order]
        full = np.full(len(fps), ~np.uint64(0))
        self.levels = [(self.fps, full, np.arange(len(fps)), np.arange(len(fps)) + 1)]  # pattern, mask, first child, end
        while len(group) and (group[1:] == group[:-1]).any():
            pattern, mask, _, _ = self.levels[-1]
            first = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1))
            sizes = np.diff(np.append(first, len(group)))
            at = np.arange(len(group)) - np.repeat(first, sizes)
            first = np.flatnonzero(at % FAN == 0)
            # the bits shared by all: those set in all, or in none
            ones = np.bitwise_and.reduceat(pattern & mask, first)
            zeros = np.bitwise_and.reduceat(~pattern & mask, first)
            self.levels.append((ones, ones | zeros, first, np.append(first[1:], len(group))))
            group = group[first]

    def span(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end among the fingerprints under the nodes."""
        low, high = node, node + 1
        for k in range(level, 0, -1):
            _, _, first, end = self.levels[k]
            low, high = first[low], end[high - 1]
        return low, high

    def components(self, near: int = NEAR) -> np.ndarray:
        """For each fingerprint the place of its component's first one, in the order of the index."""
        labels = np.arange(len(self.fps))
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots[i : i + _PIECE], roots[i : i + _PIECE], np.zeros(len(roots[i : i + _PIECE]), np.int64), np.zeros(len(roots[i : i + _PIECE]), np.uint64)) for i in range(0, len(roots), _PIECE)]
        while stack:
            level, a, b, found, seen = stack.pop()
            pattern, mask, first, end = self.levels[level]
            shared = mask[a] & mask[b]
            found = found + np.bitwise_count((pattern[a] ^ pattern[b]) & shared & ~seen)
            keep = found <= near
            a, b, found, shared = a[keep], b[keep], found[keep], shared[keep]
            if not len(a):
                continue
            whole = found + np.bitwise_count(~shared) <= near
            if whole.any():
                labels = self._link(labels, level, a[whole], b[whole])
            if level == 0:
                continue
            # one component already: nothing to gain below
            (la, ha), (lb, hb) = self.span(level, a), self.span(level, b)
            changes = np.concatenate(([0], np.cumsum(labels[1:] != labels[:-1])))
            done = whole | ((changes[la] == changes[ha - 1]) & (changes[lb] == changes[hb - 1]) & (labels[la] == labels[lb]))
            a, b, found, shared = a[~done], b[~done], found[~done], shared[~done]
            na, nb = end[a] - first[a], end[b] - first[b]
            pairs = na * nb
            cut = np.flatnonzero(np.diff(np.cumsum(pairs) // _PIECE)) + 1
            near_first = []
            for part in np.split(np.arange(len(a)), cut):
                n = pairs[part]
                row = np.repeat(part, n)
                k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                x, y = first[a[row]] + k // nb[row], first[b[row]] + k % nb[row]
                ok = x <= y
                if ok.any():
                    near_first.append((level - 1, x[ok], y[ok], found[row][ok], shared[row][ok]))
            stack.extend(near_first)
        return labels

    def _link(self, labels: np.ndarray, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """All members of a with the first of b, all of b with the first of a."""
        for x, y in ((a, b), (b, a)) if level else ((a, b),):
            (low, high), (to, _) = self.span(level, x), self.span(level, y)
            n = high - low
            u = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            labels = _merge(labels, u, np.repeat(to, n))
        return labels


def tables(rows: int, near: int = NEAR) -> list[int]:
    """Masks of the blocks that must agree; the more rows, the more blocks and the longer the keys."""
    blocks = near + (1 if rows < 1 << 25 else 2 if rows < 1 << 33 else 3)
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [sum(c) for c in combinations(bits, blocks - near)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _finer(vary: Column, near: int) -> Column:
    """The bits of vary in near + 1 parts, as masks that also hold all other bits."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftright", vary, b).bitwiseAND(F.lit(1)) == 1)

    def part(g: Column) -> Column:
        low, high = (F.floor(F.size(bits) * x / (near + 1)).cast("int") for x in (g, g + 1))
        own = F.aggregate(F.slice(bits, low + 1, high - low), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
        return F.bitwise_not(vary).bitwiseOR(own)

    return F.transform(F.sequence(F.lit(0), F.lit(near)), part)


def shards(fps: DataFrame, near: int = NEAR, most: int = MOST) -> DataFrame:
    """(m, k, fp): distinct fingerprints by mask and value under it, so that any two near ones meet and no shard has over most.

    A shard over most is told by counts. The bits in which its fingerprints vary at all are cut into near + 1 parts:
    two near ones agree on one of them, so they meet again in one of that many smaller shards. This goes on until no
    shard is over; it ends, since with near bits to vary in there are no more than 2 ** near fingerprints.
    """
    keys = F.explode(F.array(*(F.lit(_signed(m)).cast("long") for m in tables(fps.count(), near))))
    dealt, parts = fps.select("fp", keys.alias("m")).select("m", F.col("fp").bitwiseAND(F.col("m")).alias("k"), "fp"), []
    while True:
        sizes = dealt.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n"), F.bit_and("fp").bitwiseXOR(F.bit_or("fp")).alias("vary"))
        crowded = stash(sizes.filter(F.col("n") > max(most, 1 << near)).select("m", "k", _finer(F.col("vary"), near).alias("finer")))
        if crowded.isEmpty():
            return reduce(DataFrame.union, parts, dealt)
        marked = stash(attach(dealt, crowded, ["m", "k"]))
        parts.append(marked.filter("finer is null").select("m", "k", "fp"))
        again = marked.filter("finer is not null").select("fp", F.explode("finer").alias("m"))
        dealt = again.select("m", F.col("fp").bitwiseAND(F.col("m")).alias("k"), "fp").distinct()


def near_edges(fps: DataFrame, near: int = NEAR, most: int = MOST) -> DataFrame:
    """Of distinct fp: edges (u, v) that connect exactly the fingerprints that links of near bits connect.

    A shard yields one edge per fingerprint at most, to the first of its component there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(part: np.ndarray) -> pa.RecordBatch:
            new = np.append(True, (part[1:, 0] != part[:-1, 0]) | (part[1:, 1] != part[:-1, 1]))
            index = GrayIndex(np.cumsum(new), np.ascontiguousarray(part[:, 2]).view(np.uint64))
            labels, own = index.components(near), index.fps.view(np.int64)
            far = labels != np.arange(len(labels))
            return pa.RecordBatch.from_arrays([pa.array(own[far]), pa.array(own[labels[far]])], ["u", "v"])

        for b in batches:
            held.append(np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("m", "k", "fp")]))
            last = held[-1][-1]
            if sum(map(len, held)) >= MOST:
                part = np.concatenate(held)
                whole = int(((part[:, 0] != last[0]) | (part[:, 1] != last[1])).sum())  # the last shard may go on
                if whole:
                    yield links(part[:whole])
                    part = part[whole:]
                held = [part]
        if held:
            yield links(np.concatenate(held))

    return shards(fps, near, most).repartition("m", "k").sortWithinPartitions("m", "k").mapInArrow(run, "u bigint, v bigint")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR, most: int = MOST) -> DataFrame:
    """One row per input row: id, fp, component_id.

    A-Z is lower-cased; words are shingled by four, repeats included (fewer words: the whole sequence); a bit of the
    fingerprint is one if over half of the shingles' XXH64 have it. Rows whose fingerprints differ in at most near
    bits are linked; component_id is the smallest id that links reach, the row's own included. Null and empty texts
    have the fingerprint zero and are linked like any other. Null ids count for no component_id unless all are null.
    Repeated rows give repeated rows; an empty table gives an empty result; other columns are not read.
    """
    rows = stash(fingerprints(docs, id_col, text_col))
    firsts = stash(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(near_edges(firsts.select("fp"), near, most))
    member = firsts.join(roots.withColumnsRenamed({"u": "fp", "v": "root"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    found = rows.join(member.join(least, "root").select("fp", "component_id"), "fp")
    return found.select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, in their own columns: of each component the one with the smallest id (any one row of it).

    Rows without an id come last. Ids need not be distinct: a row is told by its id and its text's digest, which
    belong to one component only.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    stay = near_components(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text").select(F.col("component_id").alias("__key")).distinct()
    return docs.withColumn("__key", key).join(stay, "__key").dropDuplicates(["__key"]).select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_components of documents; see there for nulls, empty texts and repeated rows."""
    found = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


SQL: dict[str, str] = {}
QUERIES = {"op9_simhash": op9_simhash}
