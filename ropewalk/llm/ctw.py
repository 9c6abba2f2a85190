"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary choices. For each choice a context tree over the bytes before it, up to DEPTH of them, holds
counts of zeros and ones; every node makes a Krichevsky-Trofimov estimate, and a node's weighted probability is the
mean of its own estimate's and of its children's product. From the root down that weighting is a mixture of the
estimates of all depths; contexts never seen in training leave their share to the deepest one seen.

Training counts the corpus's byte grams: those of a block of texts first, then over all blocks, dealt by the SPLIT
bytes next to the symbol, so that a task holds whole subtrees from depth SPLIT on. The depths above, whose contexts
are too short to grow with the corpus, are the driver's. Scoring asks for each distinct gram of a block once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import (
    Block,
    _grouped,
    answer,
    bits_for,
    deal_words,
    dictionaries,
    expand,
    from_planes,
    pack_dealt,
    pack_words,
    planes,
    read_texts,
    reassemble,
    squeeze,
    texts_row,
    unpack_words,
    with_texts,
)
from .common import held_out, stash, tidy

DEPTH, SPLIT = 6, 3  # 7 at most: a gram is a 64-bit word of its context, the nearest byte first, and its symbol
GRAMS, WORDS, TOPS = 0, 1, 2
BLOCK, PER_BUCKET = 6 << 20, 2 << 20  # bytes of text in a block, and in the corpus for each bucket
PER_ROW = 1 << 22  # grams or words of a bucket's model in one row
START = END = b"\xff"  # no byte of UTF-8
_U = np.uint64
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte and end of the texts, and where each text's start."""
    flat = np.frombuffer(b"".join(START * DEPTH + t + END for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    code = np.zeros(max(0, len(flat) - DEPTH), np.uint64)
    for j in (*range(DEPTH - 1, -1, -1), DEPTH):
        code <<= _U(8)
        code |= flat[j : j + len(code)]
    keep = np.ones(len(code), bool)  # not the symbols that are padding
    for k in range(DEPTH):
        keep[(first + DEPTH * np.arange(len(texts)))[1:] - DEPTH + k] = False
    return code[keep], first


def places(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams in order, and for each gram its place among them."""
    order = np.argsort(code)
    own = code[order]
    new = np.append(True, own[1:] != own[:-1])[: len(own)]
    own = own[new]
    order = order.astype(np.int32)
    out = np.empty(len(code), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return own, out


def tokens(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each word's place in the dictionary, the dictionary in order of appearance, and the number of words of each text."""
    flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inner = ~_SPACES[flat]
    edge = np.flatnonzero(np.diff(inner, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    cuts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat[inner])]).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary, np.diff(np.searchsorted(starts, cuts))


def _split(keys: np.ndarray, bits: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Of grams in order: their order by bucket, and (bucket, from, to) in it."""
    h = (keys >> _U(8 * (DEPTH + 1 - SPLIT))) * _U(0x9E3779B97F4A7C15)
    bucket = ((h ^ (h >> _U(29))) * _U(0xD6E8FEB86659FD93) >> _U(64 - bits)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    return order, list(zip(bucket[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=False))


def pack_grams(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=_U(0)), 8, 9)


def unpack_grams(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


def pack_logs(x: np.ndarray) -> bytes:
    """Floats to about six digits, bytes of equal weight packed by themselves."""
    low = np.uint32(8)
    raw = ((x.astype(np.float32).view(np.uint32) + low) & ~np.uint32(2 * low - 1)).view(np.uint8).reshape(-1, 4)
    parts = [squeeze(np.ascontiguousarray(raw[:, j])) for j in range(4)]
    return np.array([*map(len, parts)], np.uint32).tobytes() + b"".join(parts)


def unpack_logs(data: bytes) -> np.ndarray:
    ends = 16 + np.cumsum(np.frombuffer(data, np.uint32, 4))
    parts = [expand(data[e - n : e], np.uint8) for e, n in zip(ends.tolist(), np.frombuffer(data, np.uint32, 4).tolist(), strict=True)]
    return np.ascontiguousarray(np.stack(parts, axis=1)).view(np.float32).reshape(-1)


def items(block: Block, bits: int) -> Iterator[tuple[int, int, bytes, bytes | None, list[int] | None]]:
    """A block's distinct grams and words with their counts in its marked (training) texts."""
    learn = [t for t, m in zip(block.texts, block.marks, strict=True) if m]
    for texts, sign in ((learn, 1), ([t for t, m in zip(block.texts, block.marks, strict=True) if not m], 0)):
        part, n = np.unique(grams(texts)[0], return_counts=True) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if sign:
            keys, counts = part, n
        else:
            keys, counts = _added([keys, part], [counts, 0 * n])
    order, parts = _split(keys, bits)
    keys, counts = keys[order], counts[order]
    for u, lo, hi in parts:
        yield GRAMS, u, pack_grams(keys[lo:hi]), planes(counts[lo:hi], 8, 3), None
    word, dictionary, n = tokens(block.texts)
    counts = np.bincount(word[np.repeat(np.array(block.marks, bool), n)], minlength=len(dictionary))
    order, parts, size, data = deal_words(dictionary, bits)
    at = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    for u, lo, hi in parts:
        yield WORDS, u, pack_dealt(size[lo:hi], data[at[lo] : at[hi]], 3), planes(counts[order[lo:hi]]), None
    yield texts_row(block, 9)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and their counts in all."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[at], np.add.reduceat(n, at) if len(at) else n


def merge(asked: DataFrame) -> DataFrame:
    """The training counts of all blocks: kind, bucket, keys, counts, items, total; PER_ROW keys a row, in order.

    Of kind TOPS: a bucket's sums for the contexts of SPLIT - 1 bytes that its subtrees hang on.
    """

    def reply(groups: Iterator) -> Iterator[tuple]:
        for kind, bucket, rows in groups:
            if kind == WORDS:
                total: Counter[bytes] = Counter()
                for r in rows:
                    for w, n in zip(unpack_words(r["keys"]), from_planes(r["counts"]).tolist(), strict=True):
                        if n:
                            total[w] += n
                own = sorted(total)
                for i in range(0, len(own), PER_ROW):
                    few = own[i : i + PER_ROW]
                    yield kind, bucket, pack_words(few), squeeze(np.array([total[w] for w in few], np.int64)), len(few), sum(total[w] for w in few)
            else:
                keys, counts, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
                for last, r in _ended(rows):
                    n = from_planes(r["counts"]).astype(np.int64)
                    held.append((unpack_grams(r["keys"])[n > 0], n[n > 0]))
                    if last or sum(len(k) for k, _ in held) > max(1 << 20, len(keys)):
                        keys, counts = _added([keys, *(k for k, _ in held)], [counts, *(c for _, c in held)])
                        held = []
                for i in range(0, len(keys), PER_ROW):
                    few = counts[i : i + PER_ROW]
                    yield kind, bucket, pack_grams(keys[i : i + PER_ROW]), squeeze(few), len(few), int(few.sum())
                tops = [np.concatenate(x) for x in zip(*Trees(keys, counts).summary, strict=True)]
                yield TOPS, bucket, squeeze(tops[0].astype(np.int64)), squeeze(np.concatenate(tops[1:]).astype(float)), len(tops[0]), 0

    schema = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("items", pa.int64()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in reply(_grouped(batches, ("kind", "bucket"))):
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True))], schema)
        tidy()

    rows = asked.filter(F.col("kind").isin(GRAMS, WORDS)).select("kind", "bucket", "keys", "counts")
    return rows.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(run, "kind tinyint, bucket int, keys binary, counts binary, items bigint, total bigint")


def _ended(rows: Iterator) -> Iterator[tuple[bool, dict]]:
    before = None
    for r in rows:
        if before is not None:
            yield False, before
        before = r
    if before is not None:
        yield True, before


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, after a shift to 8 and more."""
    x, out = x.astype(float), np.zeros(len(x))
    for _ in range(8):
        low = x < 8
        out[low] -= np.log(x[low])
        x[low] += 1
    return out + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


_SMALL = 1 << 12
_TABLES = {half: _log_gamma(np.arange(_SMALL) + half) for half in (0.5, 1.0)}


def _log_gamma_of(n: np.ndarray, half: float) -> np.ndarray:
    """Of whole numbers and half."""
    out = _TABLES[half][np.minimum(n, _SMALL - 1).astype(np.int64)]
    large = np.flatnonzero(n >= _SMALL)
    out[large] = _log_gamma(n[large] + half)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _log_gamma_of(zeros, 0.5) + _log_gamma_of(ones, 0.5) - math.log(math.pi) - _log_gamma_of(zeros + ones, 1.0)


def _weigh(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log probability and the share of the own estimate."""
    weighted = np.logaddexp(own, below) - math.log(2)
    return weighted, np.exp(own - weighted - math.log(2))


def _node(code: np.ndarray, depth: int, choice: int) -> np.ndarray:
    """A tree's nodes: the context's nearest depth bytes, and the bits of the symbol before the choice behind a one."""
    bits = _U(1 << choice) | ((code & _U(255)) >> _U(8 - choice))
    return (code >> _U(8 * (DEPTH + 1 - depth)) << _U(8)) | bits if depth else bits


def _above(node: np.ndarray) -> np.ndarray:
    """The same without the context's farthest byte."""
    return (node >> _U(16) << _U(8)) | (node & _U(255))


def _is_one(code: np.ndarray, choice: int) -> np.ndarray:
    return ((code >> _U(7 - choice)) & _U(1)).astype(bool)


@dataclass
class _Level:
    """Nodes of one depth, in order: the share of the own estimate, the estimate of a one, each node's place above."""

    keys: np.ndarray
    share: np.ndarray
    one: np.ndarray
    above: np.ndarray | None


def _lift(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None, least: int, depth: int) -> tuple[list[_Level], tuple]:
    """Levels from depth up to least, shallowest first, and (node, zeros, ones, below) of the depth above them."""
    levels = []
    for _ in range(depth, least - 1, -1):
        own = log_kt(zeros, ones)
        weighted, share = (own, np.ones(len(own))) if below is None else _weigh(own, below)
        up, above = np.unique(_above(node), return_inverse=True)
        levels.append(_Level(node, share, (ones + 0.5) / (zeros + ones + 1), above))
        zeros, ones, below = (np.bincount(above, v, len(up)) for v in (zeros, ones, weighted))
        node = up
    return levels[::-1], (node, zeros, ones, below)


def _lower(levels: list[_Level], mixed: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each level (keys, the mixture if a context ends there, the mixture so far, the share left)."""
    for x in levels:
        mixed, left = mixed[x.above], left[x.above]
        full = mixed + left * x.one
        mixed, left = mixed + left * x.share * x.one, left * (1 - x.share)
        yield x.keys, full, mixed, left


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted among keys, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class Top:
    """The depths below SPLIT of all subtrees: (keys, mixture if a context ends there) each, and what goes on down."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        levels, (root, z, o, b) = _lift(node, zeros, ones, below, 1, SPLIT - 1)
        every = np.zeros((3, 256))
        every[:, root.astype(np.int64)] = z, o, b
        z, o, b = every
        one = (o + 0.5) / (z + o + 1)
        _, share = _weigh(log_kt(z, o), b)
        mixed, left = (share * one)[root.astype(np.int64)], (1 - share)[root.astype(np.int64)]
        self.root, self.levels = one, []
        for keys, full, mixed, left in _lower(levels, mixed, left):
            self.levels.append((keys, full))
        self.last = (self.levels[-1][0], mixed, left)

    def down(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mixture so far and share left at nodes of the last depth."""
        keys, mixed, left = self.last
        at, _ = _find(keys, node)
        return mixed[at], left[at]


class Trees:
    """The subtrees from depth SPLIT on of a bucket's contexts, for each of the eight choices."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.levels, self.leaf, self.summary = keys, [], [], []
        for choice in range(8):
            one, node = _is_one(keys, choice), _node(keys, DEPTH, choice)
            first = np.append(True, node[1:] != node[:-1])[: len(node)]
            at = np.flatnonzero(first)
            zeros, ones = (np.add.reduceat(np.where(side, counts, 0), at).astype(float) if len(at) else np.zeros(0) for side in (~one, one))
            levels, above = _lift(node[at], zeros, ones, None, SPLIT, DEPTH)
            self.leaf.append(np.cumsum(first) - 1)
            self.levels.append(levels)
            self.summary.append(above)

    def spread(self, top: Top) -> None:
        """From the top down: the mixture over the depths so far, as it is if a context ends here."""
        self.top, self.logs, self.full = top, np.zeros(len(self.keys)), []
        for choice in range(8):
            levels = [(keys, full) for keys, full, _, _ in _lower(self.levels[choice], *top.down(self.summary[choice][0]))]
            full = levels[-1][1][self.leaf[choice]]
            self.logs += np.log10(np.where(_is_one(self.keys, choice), full, 1 - full))
            self.full.append(levels)
        self.levels, self.leaf, self.summary = [], [], []

    def log10(self, asked: np.ndarray) -> np.ndarray:
        """Of grams, seen or not, in order."""
        at, seen = _find(self.keys, asked)
        out = np.zeros(len(asked))
        out[seen] = self.logs[at[seen]]
        new = asked[~seen]
        if len(new):
            total = np.zeros(len(new))
            for choice in range(8):
                full = self.top.root[_node(new, 0, choice).astype(np.int64)]
                for depth, (keys, own) in enumerate([*self.top.levels, *self.full[choice]], 1):
                    at, there = _find(keys, _node(new, depth, choice))
                    full[there] = own[at[there]]
                total += np.log10(np.where(_is_one(new, choice), full, 1 - full))
            out[~seen] = total
        return out


def top_of(model: DataFrame) -> Top:
    """The sums for contexts of SPLIT - 1 bytes over all buckets; as many rows as there are such contexts come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(expand(k, np.int64)), *map(pa.array, expand(c, float).reshape(3, -1))], ["node", "z", "o", "w"])

    rows = model.filter(F.col("kind") == TOPS).select("keys", "counts").mapInArrow(run, "node bigint, z double, o double, w double")
    got = rows.groupBy("node").agg(F.sum("z").alias("z"), F.sum("o").alias("o"), F.sum("w").alias("w")).toArrow().sort_by("node")
    return Top(got.column("node").to_numpy().astype(np.uint64), *(got.column(c).to_numpy() for c in ("z", "o", "w")))


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, learned, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where learn (of the id) holds, and scores all. A-Z is lower-cased; null texts count as
    empty. Tokens are the words and one end. base_score sums log10((c + 1) / (N + V + 1)) over the tokens, c being a
    token's count in training, N the number of training tokens and V of distinct ones. score is the log10
    probability of the text's bytes and its end under context-tree weighting. Repeated rows and null ids are rows
    like others; without training rows every bit has probability 1/2; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("mark"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size, ends = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("mark")).first()
    bits = bits_for(size, PER_BUCKET, most=12)
    asked = stash(dictionaries(rows, lambda block: items(block, bits), bytes.lower, BLOCK))
    model = stash(merge(asked))
    top = top_of(model)
    words = model.filter(F.col("kind") == WORDS).agg(F.coalesce(F.sum("items"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    total, distinct = words[1] + ends, words[0] + (ends > 0)
    shared = docs.sparkSession.sparkContext.broadcast(top)

    def reply(kind: int, bucket: int, group: Iterator[dict]) -> Iterator[tuple[int, bytes]]:
        known: dict[bytes, int] = {}
        model_rows, trees = [], None
        for r in group:
            if r["block"] is None and kind == WORDS:
                known.update(zip(unpack_words(r["keys"]), expand(r["counts"], np.int64).tolist(), strict=True))
            elif kind == WORDS:
                yield r["block"], planes(np.array([known.get(w, 0) for w in unpack_words(r["keys"])], np.int64))
            elif r["block"] is None:
                model_rows.append((unpack_grams(r["keys"]), expand(r["counts"], np.int64)))
            else:
                if trees is None:
                    trees = Trees(*_added([np.zeros(0, np.uint64), *(k for k, _ in model_rows)], [np.zeros(0, np.int64), *(n for _, n in model_rows)]))
                    trees.spread(shared.value)
                    model_rows = []
                yield r["block"], pack_logs(trees.log10(unpack_grams(r["keys"])))

    def finish(held: dict[tuple[int, int], bytes], row: dict) -> dict[str, list]:
        texts = read_texts(row["keys"], row["sizes"])
        code, first = grams(texts)
        code, place = places(code)
        order, parts = _split(code, bits)
        logs = np.empty(len(code), np.float32)
        logs[order] = np.concatenate([unpack_logs(held[GRAMS, u]) for u, _, _ in parts])
        score = np.add.reduceat(logs[place], first, dtype=np.float64)
        del code, place, order, logs
        word, dictionary, n = tokens(texts)
        order, parts, _, _ = deal_words(dictionary, bits)
        count = np.empty(len(dictionary), np.int64)
        count[order] = np.concatenate([np.zeros(0, np.int64), *(from_planes(held[WORDS, u]).astype(np.int64) for u, _, _ in parts)])
        c = np.full(len(word) + len(n), ends, np.int64)  # each text's words, and then its end
        last = np.cumsum(n + 1) - 1
        inner = np.ones(len(c), bool)
        inner[last] = False
        c[inner] = count[word]
        base = np.add.reduceat(np.log10((c + 1) / (total + distinct + 1)), last - n)
        return {"n_tokens": (n + 1).tolist(), "n_known": np.add.reduceat((c > 0).astype(np.int64), last - n).tolist(), "base_score": base.tolist(), "score": score.tolist()}

    known = model.filter(F.col("kind") != TOPS)
    done = reassemble(with_texts(asked, answer(asked.withColumn("counts", F.lit(None).cast("binary")), known, reply)), finish, "n_tokens bigint, n_known bigint, base_score double, score double")
    return done.select(F.col("id").alias(id_col), F.col("mark").alias("learned"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_texts of documents, a seventh of them held out from training; see there for nulls, empty texts and repeats."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score_texts(docs, ~held_out("doc_id", 7, 2))
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


SQL: dict[str, str] = {}
QUERIES = {"op2_ctw": op2_ctw}
