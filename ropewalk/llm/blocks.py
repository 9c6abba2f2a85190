"""Work on distinct items (words, byte grams) of blocks of documents.

Texts are packed into blocks of a bounded size where they are read. A block's distinct items, not their occurrences,
go to the tasks that own them, dealt by bucket; the answers go back by block and meet the block's texts again. Hot
items so reach a task once per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import tidy

#: Bytes of text after which a block ends; a longer text is a block of its own.
BLOCK = 8 << 20
#: Rows that hold the block itself; other kinds hold items.
TEXTS = 9
ROW = [("kind", pa.int8()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]
COLUMNS = "kind tinyint, bucket int, block bigint, keys binary, counts binary, ids array<{id}>, marks array<boolean>, sizes array<bigint>"


def squeeze(x: np.ndarray | bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(x if isinstance(x, bytes) else x.tobytes())


def expand(x: bytes, kind: Any = None) -> Any:
    out = zstandard.ZstdDecompressor().decompress(x)
    return out if kind is None else np.frombuffer(out, kind)


def planes(x: np.ndarray, size: int = 8, level: int = 1) -> bytes:
    """The lowest size bytes of each number, bytes of equal weight together, which packs better."""
    return squeeze(np.ascontiguousarray(x.astype("<u8" if size > 4 else "<u4").view(np.uint8).reshape(len(x), -1)[:, :size].T), level)


def from_planes(data: bytes, size: int = 8) -> np.ndarray:
    raw = expand(data, np.uint8).reshape(size, -1)
    out = np.zeros((raw.shape[1], 8 if size > 4 else 4), np.uint8)
    out[:, :size] = raw.T
    return out.reshape(-1).view("<u8" if size > 4 else "<u4")


def pack_words(words: list[bytes], level: int = 1) -> bytes:
    return squeeze(np.array([len(words), *map(len, words)], np.uint32).tobytes() + b"".join(words), level)


def unpack_words(data: bytes) -> list[bytes]:
    raw = expand(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 * (n + 1)
    starts = [4 * (n + 1), *ends[:-1].tolist()] if n else []
    return [raw[s:e] for s, e in zip(starts, ends.tolist(), strict=True)]


def _parts(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bytes of a binary array."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return np.diff(at), np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]


def deal_words(words: pa.Array, bits: int) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """Deals non-empty words (binary) to 2**bits buckets by hash, in the order given within each.

    Their order by bucket; (bucket, from, to) in that order; and the ordered words' lengths and bytes.
    """
    if not len(words):
        return np.zeros(0, np.int64), [], np.zeros(0, np.int32), np.zeros(0, np.uint8)
    size, data = _parts(words)
    starts = np.cumsum(size, dtype=np.int64) - size
    power = np.multiply.accumulate(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
    h = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(starts, size)], starts)
    bucket = (((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    size, data = _parts(words.take(pa.array(order)))
    return order, list(zip(bucket[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(words)], strict=True)), size, data


def pack_dealt(size: np.ndarray, data: np.ndarray, level: int = 1) -> bytes:
    """As pack_words, of words' lengths and bytes."""
    return squeeze(np.append(len(size), size).astype(np.uint32).tobytes() + data.tobytes(), level)


def bits_for(size: int, per_bucket: int, least: int = 6, most: int = 14) -> int:
    """So many bits that a bucket gets about per_bucket bytes of a corpus of this size."""
    return min(most, max(least, (max(0, size - 1) // per_bucket).bit_length()))


@dataclass
class Block:
    ids: list
    marks: list[bool]
    texts: list[bytes]


def texts_row(block: Block, level: int = 1) -> tuple[int, int, bytes, None, list[int]]:
    """The block's texts as they are."""
    return TEXTS, 0, squeeze(b"".join(block.texts), level), None, [len(t) for t in block.texts]


def read_texts(data: bytes, sizes: list[int]) -> list[bytes]:
    raw, ends = expand(data), np.cumsum(sizes, dtype=np.int64).tolist()
    return [raw[e - n : e] for e, n in zip(ends, sizes, strict=True)]


def dictionaries(docs: DataFrame, items: Callable[[Block], Iterator[tuple[int, int, bytes, bytes | None, list[int] | None]]], fold: Callable[[bytes], bytes] = bytes, block: int = BLOCK) -> DataFrame:
    """Of docs (id, mark, text): a row for each (kind, bucket, keys, counts, sizes) that items yields for a block.

    One of them is of kind TEXTS: it stands for the block's texts, sizes having a number for each.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, n, schema = TaskContext.get().partitionId() << 32, Block([], [], []), 0, None

        def rows() -> pa.RecordBatch:
            made = [{"kind": k, "bucket": u, "block": number, "keys": keys, "counts": c, "sizes": z} | ({"ids": part.ids, "marks": part.marks} if k == TEXTS else {}) for k, u, keys, c, z in items(part)]
            return pa.RecordBatch.from_pylist(made, schema)

        for b in batches:
            lists = {"ids": b.schema.field("id").type, "marks": pa.bool_(), "sizes": pa.int64()}
            schema = schema or pa.schema([*ROW, *((c, pa.list_(t)) for c, t in lists.items())])
            for i, mark, text in zip(b.column("id"), b.column("mark"), b.column("text"), strict=True):
                text = fold(text.as_py())
                if part.texts and n + len(text) > block:
                    yield rows()
                    tidy()
                    number, part, n = number + 1, Block([], [], []), 0
                part.ids.append(i.as_py())
                part.marks.append(mark.as_py())
                part.texts.append(text)
                n += len(text)
        if part.texts:
            yield rows()
        tidy()

    return docs.select("id", "mark", F.col("text").cast("binary").alias("text")).mapInArrow(run, COLUMNS.format(id=kind))


def answer(asked: DataFrame, known: DataFrame | None, reply: Callable[[int, int, Iterator[dict]], Iterator[tuple[int, bytes]]], parts: int | None = None) -> DataFrame:
    """Deals the rows of asked by (kind, bucket), those of known (block is null) first, and gives each bucket to reply: (block, values).

    parts is the number of tasks where their size says little about their work.
    """
    rows = asked.filter(F.col("kind") != TEXTS).select("kind", "bucket", "block", "keys", "counts")
    if known is not None:
        rows = known.select("kind", "bucket", F.lit(None).cast("bigint").alias("block"), "keys", "counts").union(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((kind, bucket, *x) for kind, bucket, group in _grouped(batches, ("kind", "bucket")) for x in reply(kind, bucket, group))
        for few in _batched(found, 64):
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in few], t) for j, t in enumerate((pa.int8(), pa.int32(), pa.int64(), pa.binary()))], ["kind", "bucket", "block", "keys"])
        tidy()

    dealt = rows.repartition("kind", "bucket") if parts is None else rows.repartition(parts, "kind", "bucket")
    return dealt.sortWithinPartitions("kind", "bucket", F.col("block").asc_nulls_first()).mapInArrow(run, "kind tinyint, bucket int, block bigint, keys binary")


def answer_in_passing(asked: DataFrame, reply: Callable[[int, int, Iterator[dict]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """As answer, of rows that are not kept anywhere: those of kind TEXTS go along, dealt by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for kind, bucket, group in _grouped(_noted(batches, note := []), ("kind", "bucket")):
            schema = schema or note[0]
            if kind == TEXTS:
                for r in group:
                    yield pa.RecordBatch.from_pylist([r | {"ids": r["ids"].to_pylist()}], schema)
            else:
                for few in _batched(({"kind": kind, "bucket": bucket, "block": n, "keys": v} for n, v in reply(kind, bucket, group)), 64):
                    yield pa.RecordBatch.from_pylist(few, schema)

    deal = F.when(F.col("kind") == TEXTS, F.xxhash64("block")).otherwise(F.col("bucket").cast("long"))
    return asked.repartition("kind", deal).sortWithinPartitions("kind", "bucket").mapInArrow(run, asked.schema)


def reassemble(rows: DataFrame, finish: Callable[[dict[tuple[int, int], bytes], dict], dict[str, list | pa.Array]], schema: str) -> DataFrame:
    """Brings each block's answers, by (kind, bucket), and its row of kind TEXTS together; finish gives columns with a value for each text."""
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(batches, ("block",)):
            held: dict[tuple[int, int], bytes] = {}
            for r in group:
                if r["kind"] != TEXTS:
                    held[r["kind"], r["bucket"]] = r["keys"]
                    continue
                done = finish(held, r)
                yield pa.RecordBatch.from_arrays([r["ids"], pa.array(r["marks"], pa.bool_()), *(x if isinstance(x := done[c], pa.Array) else pa.array(x) for c in names)], ["id", "mark", *names])
                held, done = {}, None
            tidy()

    kept = rows.select("block", "kind", "bucket", "keys", "counts", "ids", "marks", "sizes")
    id_type = rows.schema["ids"].dataType.elementType.simpleString()
    return kept.repartition("block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(run, f"id {id_type}, mark boolean, {schema}")


def with_texts(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """The answers and the rows of kind TEXTS, for reassemble."""
    return answers.unionByName(asked.filter(F.col("kind") == TEXTS), allowMissingColumns=True)


def _batched(rows: Iterator, n: int) -> Iterator[list]:
    few = []
    for x in rows:
        few.append(x)
        if len(few) == n:
            yield few
            few = []
    if few:
        yield few


def _noted(batches: Iterator[pa.RecordBatch], schemas: list[pa.Schema]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        schemas.append(b.schema)
        yield b


def _grouped(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator:
    """(*key, rows) for each run of equal keys, read as they come. Ids stay Arrow arrays."""

    def rows() -> Iterator[dict]:
        for b in batches:
            columns = {c: b.column(c) for c in b.schema.names}
            for i in range(len(b)):
                yield {c: (v[i].values if c == "ids" and v[i].is_valid else v[i].as_py()) for c, v in columns.items()}

    for key, group in groupby(rows(), key=lambda r: tuple(r[c] for c in by)):
        yield (*key, group)
