"""Removal of repeated byte strings by suffix order and threshold-bounded interval expansion.

Equal strings of LENGTH bytes must meet in one task. Every window of that length has an anchor, the leftmost of its
32-byte grams with the least hash, and equal windows have equal anchors. Windows with one anchor that follow each
other make a context. Blocks of texts first exchange the hashes of their anchors; only contexts whose anchor occurs
elsewhere are then dealt, by that hash. Where an anchor occurs very often its contexts' windows exchange hashes too,
dealt by window, and only runs of windows that occur elsewhere go on: what is left of the many contexts around a
common passage is the same. Equal contexts are told by content, first in a block, then in a shard. The different ones that share an anchor are written one after the other, their suffixes are sorted by their first 128
bytes, and on the Burrows-Wheeler transform backward extension finds common-prefix lengths in increasing order,
breadth first, until LENGTH: suffixes between which no smaller length was found share LENGTH bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import ROW, TEXTS, Block, _batched, _grouped, answer, dictionaries, expand, from_planes, pack_words, planes, read_texts, reassemble, squeeze, texts_row, unpack_words, with_texts
from .common import stash, tidy

LENGTH, GRAM = 100, 32
#: Bytes of the corpus for each bucket of anchors, which bounds what a task holds; bytes of contexts judged at once.
PER_BUCKET, AT_ONCE = 4 << 20, 1 << 20
#: Contexts with one anchor in the corpus beyond which their windows are sifted first.
HOT = 1000
HASHES, CONTEXTS, WINDOWS, SIFTED = 0, 1, 2, 3
MOST_TASKS = 4096  # that judge; packed contexts are small for the work they make, so their number is given
_U = np.uint64
_MIX = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) | _U(1)


def gram_hashes(flat: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from every place on (GRAM a power of two)."""
    h = _MIX[flat]
    k, factor = 1, 0x9E3779B97F4A7C15
    while k < GRAM:
        right = h[k:].copy()
        h = h[: len(right)]
        h *= _U(factor)
        h += right
        k, factor = 2 * k, factor * factor % (1 << 64)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    return h


def contexts(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: each context's anchor hash, text, start in the text, and number of windows; in order of place."""
    sizes = np.array([len(t) for t in texts], np.int64)
    windows = np.maximum(0, sizes - length + 1)
    if not windows.any():
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    flat = np.frombuffer(b"".join(texts), np.uint8)
    h = gram_hashes(flat)
    n = len(flat) - length + 1
    least = np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost
    least |= h & ~_U(0xFFFFFFFF)
    width, have = length - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    anchor = least[:n].astype(np.uint32)
    del least
    first = np.cumsum(sizes) - sizes
    inside = np.zeros(n, bool)
    for f, w in zip(first[windows > 0].tolist(), windows[windows > 0].tolist(), strict=True):
        inside[f : f + w] = True
    anchor = anchor[inside]
    del inside
    of = np.repeat(np.arange(len(texts), dtype=np.int32), windows)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1]))
    at = np.flatnonzero(new)
    own = of[at]
    return h[anchor[at]], own.astype(np.int64), at - (np.cumsum(windows) - windows)[own], np.diff(np.append(at, len(anchor)))


def union(of: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(text, start, end) of the maximal runs that the spans cover."""
    if not len(of):
        return np.zeros((3, 0), np.int64)
    base = of << 32
    order = np.argsort(base + start, kind="stable")
    low, high = (base + start)[order], np.maximum.accumulate((base + end)[order])
    first = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
    last = np.append(first[1:], len(low)) - 1
    of = low[first] >> 32
    return np.stack([of, low[first] - (of << 32), high[last] - (of << 32)])


def _deal(h: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indexes by bucket. Anchors are least hashes, whose first bits are far from even: the hash is mixed again."""
    bucket = (((h ^ (h >> _U(32))) * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=False):
        yield int(bucket[lo]), order[lo:hi]


def _hashes_of(h: np.ndarray) -> np.ndarray:
    """48 bits that are exchanged, in order; a chance agreement only adds work."""
    return np.sort(h & _U((1 << 48) - 1))


def _counted(h: np.ndarray, bits: int, kind: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(kind, bucket, hashes, counts) of the distinct ones among hashes."""
    for u, part in _deal(h, bits):
        keys, n = np.unique(_hashes_of(h[part]), return_counts=True)
        yield kind, u, planes(np.diff(keys, prepend=_U(0))), planes(np.minimum(n, 0xFFFF), 2)


def items(block: Block, bits: int) -> Iterator[tuple[int, int, bytes, bytes | None, list[int] | None]]:
    """By bucket the distinct hashes of anchors, and how often each occurs in the block."""
    for kind, u, keys, counts in _counted(contexts(block.texts)[0], bits, HASHES):
        yield kind, u, keys, counts, None
    yield texts_row(block, 6)


def _repeated(kind: int, bucket: int, group: Iterator[dict], hot: int) -> Iterator[tuple[int, bytes]]:
    """For each block and each of its hashes: 0 if it occurs once in all, 1 if more often, 2 if more than hot times."""
    held = [(r["block"], np.cumsum(from_planes(r["keys"]), dtype=np.uint64), from_planes(r["counts"], 2)) for r in group]
    keys, place = np.unique(np.concatenate([k for _, k, _ in held]), return_inverse=True)
    n = np.bincount(place, np.concatenate([c for _, _, c in held]).astype(float), len(keys))
    degree = ((n > 1).astype(np.uint8) + (n > hot).astype(np.uint8))[place]
    for (block, own, _), end in zip(held, np.cumsum([len(k) for _, k, _ in held]).tolist(), strict=True):
        yield block, squeeze(degree[end - len(own) : end])


def _degrees(h: np.ndarray, bits: int, held: dict[tuple[int, int], bytes], kind: int) -> np.ndarray:
    """What _repeated has said of each of the hashes."""
    out = np.zeros(len(h), np.uint8)
    for u, part in _deal(h, bits):
        _, place = np.unique(h[part] & _U((1 << 48) - 1), return_inverse=True)
        out[part] = expand(held[kind, u], np.uint8)[place]
    return out


def _places(h: np.ndarray, ids: np.ndarray, of: np.ndarray, start: np.ndarray, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different ones of a block's contexts, their (hash, id, text, start), and the spans of those that come again.

    Of equal ones the first by id, then by place, is the one, as _judge orders them.
    """
    first: dict[bytes, int] = {}
    again = []
    for i in np.lexsort((start, of, ids)).tolist():
        if first.setdefault(words[i], i) != i:
            again.append(i)
    own, again = np.array(list(first.values()), np.int64), np.array(again, np.int64)
    ends = start[again] + np.array([len(words[i]) for i in again.tolist()], np.int64)
    return list(first), np.stack([h[own].view(np.int64), ids[own], of[own], start[own]]), union(of[again], start[again], ends)


def _dealt(words: list[bytes], where: np.ndarray, again: np.ndarray, bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(kind, bucket, contexts, their number, places and the spans of those that come again) by the anchors' hashes."""
    for u, part in _deal(where[0].view(np.uint64), bits):
        yield CONTEXTS, u, pack_words([words[i] for i in part.tolist()]), squeeze(np.concatenate(([len(part)], where[:, part].reshape(-1))).astype(np.int64))
    if again.size:
        yield CONTEXTS, 0, pack_words([]), squeeze(np.concatenate(([0], again.reshape(-1))).astype(np.int64))


def _window_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every window of the contexts, and the number of windows of each."""
    sizes = np.array([len(w) for w in words], np.int64)
    n = sizes - LENGTH + 1
    if not len(words):
        return np.zeros(0, np.uint64), n
    h = gram_hashes(np.frombuffer(b"".join(words), np.uint8))
    at = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n) - n), n) + np.arange(n.sum())
    out = np.zeros(len(at), np.uint64)
    for k in (0, GRAM, 2 * GRAM, LENGTH - GRAM):  # which cover a window
        out = (out ^ h[at + k]) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(31)
    return out, n


def _shared_contexts(held: dict[tuple[int, int], bytes], ids: np.ndarray, texts: list[bytes], bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Of the contexts whose anchor occurs elsewhere: by bucket those to judge; and those to sift, with their windows' hashes."""
    h, of, start, windows = contexts(texts)
    degree = _degrees(h, bits, held, HASHES)
    for d in (1, 2):
        at = np.flatnonzero(degree == d)
        words = [texts[t][s:e] for t, s, e in zip(of[at].tolist(), start[at].tolist(), (start[at] + windows[at] + LENGTH - 1).tolist(), strict=True)]
        words, where, again = _places(h[at], ids[of[at]], of[at], start[at], words)
        if d == 1:
            yield from _dealt(words, where, again, bits)
        elif words:
            yield from _counted(_window_hashes(words)[0], bits, WINDOWS)
            yield SIFTED, 0, pack_words(words), squeeze(np.concatenate(([len(words)], where.reshape(-1), again.reshape(-1))).astype(np.int64))


def _sift(held: dict[tuple[int, int], bytes], row: dict, bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """As _dealt, of the runs of windows that occur elsewhere."""
    words, x = unpack_words(row["keys"]), expand(row["counts"], np.int64)
    n = int(x[0])
    where, again = x[1 : 4 * n + 1].reshape(4, n), x[4 * n + 1 :].reshape(3, -1)
    h, windows = _window_hashes(words)
    keep = np.flatnonzero(_degrees(h, bits, held, WINDOWS))
    of = np.repeat(np.arange(n), windows)[keep]
    at = keep - (np.cumsum(windows) - windows)[of]
    cut = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1))[: len(of)])
    last = np.append(cut[1:], len(of))[: len(cut)] - 1
    of, low, high = of[cut], at[cut], at[last] + LENGTH
    parts = [words[i][s:e] for i, s, e in zip(of.tolist(), low.tolist(), high.tolist(), strict=True)]
    words, where, more = _places(np.ascontiguousarray(where[0, of]).view(np.uint64), where[1, of], where[2, of], where[3, of] + low, parts)
    yield from _dealt(words, where, np.concatenate((again, more), axis=1), bits)


def suffix_order(text: np.ndarray, reach: int = 128) -> np.ndarray:
    """Suffixes sorted by their first reach bytes, at least, by prefix doubling from eight bytes on."""
    n = len(text)
    rank = np.zeros(n + 8, np.uint64)
    padded = np.append(text, np.zeros(8, np.uint8)).astype(np.uint64)
    for j in range(8):
        rank[:n] = (rank[:n] << _U(8)) | padded[j : n + j]
    order = np.argsort(rank[:n], kind="stable")
    rank, key, have = np.empty(n, np.int64), rank[:n], 8
    while True:
        key = key[order]
        new = np.append(0, np.cumsum(key[1:] != key[:-1]))
        rank[order] = new
        if have >= reach or new[-1] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - have] += rank[have:] + 1
        order = np.argsort(key, kind="stable")
        have *= 2


def short_prefixes(text: np.ndarray, order: np.ndarray, bound: int) -> np.ndarray:
    """For i from 1 on: True if suffixes order[i - 1] and order[i] have less than bound bytes in common.

    Breadth-first: an interval holds the suffixes that begin with a string of length l. Each byte that precedes one
    of them extends the string backwards, to the interval between the images of its first and last occurrence in the
    transform. Where that interval's end has no value yet, its common prefix there is l, and it is expanded in the
    next round; no other interval can bring anything new.
    """
    n = len(text)
    before = text[order - 1]  # the transform; the byte before the first suffix is the last one
    lf = np.empty(n, np.int64)
    lf[np.argsort(before, kind="stable")] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(bound):
        size = high - low
        at = np.repeat(low - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        key = np.repeat(np.arange(len(low)), size) * 256 + before[at]
        by = np.argsort(key, kind="stable")
        key = key[by]
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        new_low = lf[at[by[cut]]]
        new_high = lf[at[by[np.append(cut[1:], len(key)) - 1]]] + 1
        fresh = ~known[new_high]
        low, high = new_low[fresh], new_high[fresh]
        if not len(low):
            break
        known[high] = True
    return known[1:n]


def repeated_windows(texts: list[bytes], place: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of each window of the texts that also starts at an earlier place.

    Place orders the texts; of equal windows the one in the first text, and there the leftmost, is no repeat.
    """
    text = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)  # no byte of UTF-8 ends a text
    sizes = np.array([len(t) for t in texts], np.int64)
    order = suffix_order(text, max(128, length))
    group = np.append(0, np.cumsum(short_prefixes(text, order, length)))
    first = np.cumsum(sizes + 1) - sizes - 1
    of = np.repeat(np.arange(len(texts)), sizes + 1)[order]
    start = order - first[of]
    whole = start + length <= sizes[of]
    group, of, start = group[whole], of[whole], start[whole]
    by = np.lexsort((start, place[of], group))
    group, of, start = group[by], of[by], start[by]
    again = np.append(False, group[1:] == group[:-1])[: len(group)]
    return of[again], start[again]


def _runs(of: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, first start, last start) of windows that follow each other."""
    by = np.lexsort((start, of))
    of, start = of[by], start[by]
    cut = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1))[: len(of)])
    last = np.append(cut[1:], len(of))[: len(cut)] - 1
    return zip(of[cut].tolist(), start[cut].tolist(), start[last].tolist(), strict=True)


def _judge(kind: int, bucket: int, group: Iterator[dict]) -> Iterator[tuple[int, bytes]]:
    """For each block the spans to remove: (text, start, end) each."""
    spans: dict[int, list[np.ndarray]] = {}
    found: dict[bytes, tuple] = {}
    for r in group:
        x, block = expand(r["counts"], np.int64), r["block"]
        n = int(x[0])
        h, ids, of, start = x[1 : 4 * n + 1].reshape(4, n)
        spans.setdefault(block, []).append(x[4 * n + 1 :].reshape(3, -1))
        for c, hash_, i, t, s in zip(unpack_words(r["keys"]), h.tolist(), ids.tolist(), of.tolist(), start.tolist(), strict=True):
            own = ((i, block, t, s), hash_)
            other = found.setdefault(c, own)
            if other is not own:  # of equal contexts the first stays in the race, the other goes as a whole
                late = max(own, other)
                found[c] = min(own, other)
                _, b, t, s = late[0]
                spans[b].append(np.array([[t], [s], [s + len(c)]]))
    # contexts alone with their anchor hold no string of another
    anchors, n = np.unique([h for _, h in found.values()], return_counts=True) if found else (np.zeros(0), np.zeros(0))
    shared = set(anchors[n > 1].tolist())
    race = sorted((h, p, c) for c, (p, h) in found.items() if h in shared)
    found.clear()
    start = 0
    while start < len(race):  # contexts with one anchor stay together
        end, size = start, 0
        while end < len(race) and (size < AT_ONCE or race[end][0] == race[end - 1][0]):
            size += len(race[end][2])
            end += 1
        part, start = race[start:end], end
        rank = np.empty(len(part), np.int64)
        rank[sorted(range(len(part)), key=lambda i: part[i][1])] = np.arange(len(part))
        for i, s, e in _runs(*repeated_windows([c for _, _, c in part], rank)):
            _, b, t, at = part[i][1]
            spans[b].append(np.array([[t], [at + s], [at + e + LENGTH]]))
    for b, parts in spans.items():
        yield b, squeeze(union(*np.concatenate(parts, axis=1).astype(np.int64)))


def _cut(held: dict[tuple[int, int], bytes], row: dict) -> dict[str, Any]:
    texts = read_texts(row["keys"], row["sizes"])
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1  # a place between texts keeps their spans apart
    cover = np.zeros(int((sizes + 1).sum()) + 1, np.int32)
    for data in held.values():
        of, start, end = expand(data, np.int64).reshape(3, -1)
        np.add.at(cover, first[of] + start, 1)
        np.add.at(cover, first[of] + end, -1)
    gone = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    of = np.searchsorted(first, starts, side="right") - 1
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    removed = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays([pa.array(starts - first[of]), pa.array(ends - starts)], ["start", "length"]))
    kept = [np.frombuffer(t, np.uint8)[~gone[f : f + len(t)]].tobytes() if a < b else t for t, f, a, b in zip(texts, first.tolist(), cuts[:-1], cuts[1:], strict=True)]
    return {"removed": removed, "kept": pa.array(kept, pa.binary())}


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per input row: id, n_bytes, removed (array of start, length), kept (binary).

    Each byte goes that a string of LENGTH bytes covers which also starts earlier: in a row with a smaller id, or in
    the same row further left. Strings overlap freely and are judged on the input; they never cross rows. Null texts
    count as empty. Rows with the same id come one after the other in some order; rows without an id come last. An
    empty table gives an empty result; other columns are not read. Ids are integers. hot says from how many contexts
    on those of one anchor are sifted by their windows; the result is the same.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(False).alias("mark"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(16, max(6, (size // PER_BUCKET).bit_length()))
    asked = stash(dictionaries(rows, lambda block: items(block, bits)))
    repeated = partial(_repeated, hot=hot)
    marks = answer(asked, None, repeated)

    kinds = "kind tinyint, bucket int, block bigint, keys binary, counts binary"

    def by_block(last: int, parts: Callable[[dict[tuple[int, int], bytes], dict], Iterator[tuple[int, int, bytes, bytes]]]) -> Callable:
        """Gives each block's rows to parts when that of kind last, which comes after all others, is there."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema(ROW)
            for block, group in _grouped(batches, ("block",)):
                held: dict[tuple[int, int], bytes] = {}
                for r in group:
                    if r["kind"] != last:
                        held[r["kind"], r["bucket"]] = r["keys"]
                        continue
                    for few in _batched(({"kind": k, "bucket": u, "block": block, "keys": w, "counts": c} for k, u, w, c in parts(held, r)), 32):
                        yield pa.RecordBatch.from_pylist(few, schema)
            tidy()

        return run

    def shared_of(held: dict[tuple[int, int], bytes], r: dict) -> Iterator[tuple[int, int, bytes, bytes]]:
        yield from _shared_contexts(held, r["ids"].fill_null((1 << 63) - 1).to_numpy(), read_texts(r["keys"], r["sizes"]), bits)

    met = with_texts(asked, marks).select("block", "kind", "bucket", "keys", "ids", "sizes").repartition("block").sortWithinPartitions("block", "kind", "bucket")
    shared = stash(met.mapInArrow(by_block(TEXTS, shared_of), kinds))
    seen = answer(shared.filter(F.col("kind") == WINDOWS), None, repeated).withColumn("counts", F.lit(None).cast("binary"))
    sifting = seen.union(shared.filter(F.col("kind") == SIFTED).select("kind", "bucket", "block", "keys", "counts")).repartition("block").sortWithinPartitions("block", "kind", "bucket")
    sifted = sifting.mapInArrow(by_block(SIFTED, lambda held, r: _sift(held, r, bits)), kinds)
    judged = answer(shared.filter(F.col("kind") == CONTEXTS).union(sifted), None, _judge, min(1 << bits, MOST_TASKS))
    done = reassemble(with_texts(asked, judged), _cut, "removed array<struct<start:bigint,length:bigint>>, kept binary")
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["length"])
    return done.select(F.col("id").alias(id_col), (F.octet_length("kept") + removed).alias("n_bytes"), "removed", "kept")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats of documents; see there for nulls, empty and long texts and repeated rows."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


SQL: dict[str, str] = {}
QUERIES = {"op8_repeats": op8_repeats}
