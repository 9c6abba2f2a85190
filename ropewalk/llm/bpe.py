"""Byte-level BPE by a global shuffle of distinct words.

Where texts are read they are cut into pre-tokens; a block of texts becomes its dictionary of distinct pre-tokens
and, for every position, the place in that dictionary: positions are exploded inside the block, as one packed column.
The dictionaries alone are dealt by word: each distinct word is encoded once, where all blocks' copies of it meet.
The ids join back by block and are put together by position. Decoding joins the ids with the token-byte table, a
block's at once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .blocks import TEXTS, Block, answer_in_passing, bits_for, deal_words, dictionaries, from_planes, pack_dealt, planes, reassemble, unpack_words

#: Bytes of text in a block, which the larger it is has the fewer words in common with others, and in the corpus for each bucket of words.
BLOCK, PER_BUCKET, LEVEL = 16 << 20, 8 << 20, 9
#: White space as the tokenizer's patterns mean it (Unicode White_Space), spelled out: libraries differ on \s.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """Of a file with a base64 token and its rank on each line; read on the driver."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def pre_tokenizer(pattern: str) -> regex.Pattern:
    spelled = regex.sub(r"\[\^((?:\\p\{\w\}|\\s)*)\]", lambda m: "[^" + m[1].replace(r"\s", _SPACE) + "]", pattern)
    return regex.compile(spelled.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))


class _Places(dict):
    """Words and their places, in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def block_words(block: Block, pattern: regex.Pattern, bits: int) -> Iterator[tuple[int, int, bytes, bytes | None, list[int] | None]]:
    """The block's distinct words by bucket, in order of frequency, and its texts as sequences of places in that order."""
    place = _Places()
    sequence, sizes = [], []
    for t in block.texts:
        found = pattern.findall(t.decode())
        sequence.append(np.fromiter(map(place.__getitem__, found), np.int32, len(found)))
        sizes.append(len(found))
    words, sequence = pa.array(list(place), pa.string()).cast(pa.binary()), np.concatenate(sequence)
    place.clear()
    often = np.argsort(-np.bincount(sequence, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.int32)
    rank[often] = np.arange(len(words))
    order, parts, size, data = deal_words(words.take(pa.array(often)), bits)
    at, bucket = np.concatenate(([0], np.cumsum(size, dtype=np.int64))), np.zeros(len(words), np.uint16)
    for u, lo, hi in parts:
        bucket[order[lo:hi]] = u
        yield 0, u, pack_dealt(size[lo:hi], data[at[lo] : at[hi]], LEVEL), None, None
    yield TEXTS, 0, planes(rank[sequence], 4, LEVEL), planes(bucket, 2, LEVEL), sizes


def put_together(held: dict[tuple[int, int], bytes], row: dict) -> pa.Array:
    """The ids of each text of a block, from the answers for its words."""
    bucket = from_planes(row["counts"], 2)
    lens, flat = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    own, words = np.unique(bucket, return_counts=True)
    for u, n in zip(own.tolist(), words.tolist(), strict=True):
        both = from_planes(held[0, u], 4).view(np.int32)
        lens.append(both[:n])
        flat.append(both[n:])
    by_bucket, flat = np.concatenate(lens), np.concatenate(flat)
    size, start = np.empty(len(bucket), np.int32), np.empty(len(bucket), np.int32)
    order = np.argsort(bucket, kind="stable")
    size[order], start[order] = by_bucket, np.cumsum(by_bucket) - by_bucket
    sequence = from_planes(row["keys"], 4).view(np.int32)
    n = size[sequence]
    ends = np.cumsum(n, dtype=np.int64)
    at = np.repeat((start[sequence] - (ends - n)).astype(np.int32), n)
    at += np.arange(len(at), dtype=np.int32)
    cuts = np.concatenate(([0], np.cumsum(row["sizes"], dtype=np.int64)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends))[cuts].astype(np.int32)), pa.array(flat[at]))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, decoded: bool = False) -> DataFrame:
    """One row per input row: id, ids (array of int); with decoded, the bytes that the ids stand for too.

    Every match of the pattern is encoded by itself: its bytes' lowest-ranked neighbours are merged until none can
    be. No text is a special token. Null texts count as empty and have no ids; null ids and repeated rows are rows
    like others; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.lit(False).alias("mark"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a tokenizer's, of fixed size
    bits = bits_for(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, PER_BUCKET, least=4)

    def items(part: Block) -> Iterator[tuple[int, int, bytes, bytes | None, list[int] | None]]:
        yield from block_words(part, pre_tokenizer(pattern), bits)

    def reply(kind: int, bucket: int, group: Iterator[dict]) -> Iterator[tuple[int, bytes]]:
        piece = _coder(shared.value).piece
        known: dict[bytes, list[int]] = {}
        for r in group:
            ids = [known.get(w) or known.setdefault(w, piece(w)) for w in unpack_words(r["keys"])]
            yield r["block"], planes(np.fromiter(chain(map(len, ids), chain.from_iterable(ids)), np.uint32), 4, LEVEL)

    def finish(held: dict[tuple[int, int], bytes], row: dict) -> dict[str, Any]:
        ids = put_together(held, row)
        return {"ids": ids} | ({"decoded": _coder(shared.value).look_up(ids)} if decoded else {})

    done = reassemble(answer_in_passing(dictionaries(rows, items, block=block), reply), finish, "ids array<int>" + ", decoded binary" * decoded)
    return done.drop("mark").withColumnRenamed("id", id_col)


class _Coder:
    """piece encodes one pre-token's bytes; tokens is the token-byte table, null where there is no token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.piece = tiktoken.Encoding("ranks", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        by_id = dict(zip(ranks.values(), ranks, strict=True))
        self.tokens = pa.array(map(by_id.get, range(max(by_id, default=-1) + 1)), pa.large_binary())

    def look_up(self, ids: pa.Array) -> pa.Array:
        """The bytes of each list of ids, joined from the table; null for null. Ids without a token are an error."""
        flat, n = ids.flatten(), ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        found = pc.take(self.tokens, flat)
        if found.null_count:
            raise KeyError("an id stands for no token")
        _, at, data = found.buffers()
        ends = np.frombuffer(at, np.int64)[np.concatenate(([0], np.cumsum(n, dtype=np.int64)))] if len(flat) else np.zeros(len(n) + 1, np.int64)
        whole = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.ascontiguousarray(ends)), data])
        return pc.if_else(ids.is_valid(), whole, None).cast(pa.binary()) if ids.null_count else whole.cast(pa.binary())


def _coder(ranks: dict[bytes, int], _last: list[_Coder] = []) -> _Coder:  # noqa: B006
    """Made once a process; it holds its ranks, so another table at the same address is not taken for them."""
    if not _last or _last[0].ranks is not ranks:
        _last[:] = [_Coder(ranks)]
    return _last[0]


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """encoded with decoded (binary): the bytes of the ids, one after the other; null for null ids. An unknown id is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf(BinaryType())
    def bytes_of(ids: pa.Array) -> pa.Array:
        return _coder(shared.value).look_up(ids)

    return encoded.withColumn("decoded", bytes_of(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str, pattern: str, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the documents' encoding and its decoding."""
    found = encode(docs, read_ranks(path), pattern, block=block, decoded=True)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round_trip of documents; see encode for nulls, empty and long texts and repeated rows."""
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


SQL: dict[str, str] = {}
QUERIES = {"op6_bpe": op6_bpe}
