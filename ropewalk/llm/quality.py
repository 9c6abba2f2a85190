"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words and its pairs of neighbouring bytes, hashed, and two counts of repeated words; their
weighted vector is projected onto the leading directions of the labelled texts' vectors (latent semantics). Every text is compared
with every labelled vector, exactly, a block of texts at a time; the nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import hash_sample, held_out, tidy

TERMS, DIMS, NEIGHBOURS, SHARPNESS = 2048, 32, 15, 20.0
#: Labelled texts to learn from at most (and a third more): what is broadcast is bounded by it.
SAMPLE = 6000
_BLOCK, _PIECE = 1024, 1 << 20  # texts compared at once, bytes counted at once


def terms(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed words, of hashed byte pairs, then of words like the one before and of repeated words."""
    out, half = np.zeros(TERMS + 2), TERMS // 2
    code, words = np.frombuffer(text, np.uint8), text.split()
    for w, n in Counter(words).items():
        out[xxhash.xxh32_intdigest(w) & (half - 1)] += n
    out[:half] /= max(1, len(words))
    for i in range(0, len(code) - 1, _PIECE):
        part = code[i : i + _PIECE + 1].astype(np.int32)
        out[half:TERMS] += np.bincount(((part[:-1] * 61 + part[1:] * 7919) >> 1) & (half - 1), minlength=half)
    out[half:TERMS] /= max(1, len(code))
    out[TERMS] = sum(map(operator.eq, words, words[1:])) / max(1, len(words))
    out[TERMS + 1] = (len(words) - len(set(words))) / max(1, len(words))
    return np.sqrt(out).astype(np.float32)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))


@dataclass
class Voters:
    rarity: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def latent(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, :TERMS] = _units(x[:, :TERMS] * self.rarity)
        return _units(_units(x) @ self.project)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Of rows of terms: the weighted share of label 1 among the nearest; the prior for rows without terms."""
        out = np.full(len(x), self.prior)
        k = min(NEIGHBOURS, len(self.vectors))
        some = np.flatnonzero(x.any(axis=1)) if k else []
        if len(some):
            near = self.latent(x[some]) @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.exp(SHARPNESS * (np.take_along_axis(near, top, 1).astype(float) - 1))
            out[some] = np.clip((weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1), 0, 1)
        return out


def fit(x: np.ndarray, labels: np.ndarray) -> Voters:
    """Of rows of terms and 0/1 labels."""
    rarity = (np.log((1 + len(x)) / (1 + (x[:, :TERMS] > 0).sum(axis=0))) + 0.2).astype(np.float32)
    out = Voters(rarity, np.eye(TERMS + 2, dtype=np.float32), np.zeros((0, DIMS), np.float32), labels.astype(float))
    if len(x):
        y = x.copy()
        y[:, :TERMS] = _units(y[:, :TERMS] * rarity)
        y = _units(y)
        _, directions = np.linalg.eigh(y.T @ y)
        out.project = np.ascontiguousarray(directions[:, ::-1][:, :DIMS])
        out.vectors = out.latent(x)
    return out


@F.arrow_udf(BinaryType())
def _terms(text: pa.Array) -> pa.Array:
    return pa.array([terms(t.as_py().encode()).astype(np.float16).tobytes() for t in text], pa.binary())


def learn_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Voters:
    """Learns from the labelled rows where learn, of the id, holds: about sample of them, chosen by hash.

    Null labels and ids, and labels without a document, are left out; null texts count as empty. The chosen ids are
    broadcast; their number is bounded by sample.
    """
    marked = labels.filter(learn & F.col("quality").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h"), (F.col("quality") == 1).cast("int").alias("y"))
    chosen = hash_sample(marked, marked.count(), sample)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    got = rows.select("h", "y", _terms("text").alias("x")).orderBy("h", "y").limit(2 * sample).collect()
    x = np.array([np.frombuffer(r.x, np.float16) for r in got], np.float32).reshape(len(got), TERMS + 2)
    out = fit(x, np.array([r.y for r in got], int))
    del got, x
    tidy()
    return out


def score_quality(docs: DataFrame, voters: Voters, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5 on, else 0).

    The whole text counts and nothing else. Null and empty texts get the labelled rows' share of label 1, or 0.5 if
    there are none. Every row comes back once; columns named score or predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)


    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        blocks = (text.slice(i, _BLOCK) for i in range(0, len(text), _BLOCK))
        parts = [shared.value.score(np.array([terms((t.as_py() or "").encode()) for t in b])) for b in blocks]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.withColumn("__score", score(F.col(text_col))).select(*keep, F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_quality of documents, a third of them held out from training; see there for nulls and empty texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out("doc_id", 3, 1)
    voters = learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~out)
    return score_quality(docs.select("doc_id", out.alias("held_out"), "text"), voters).drop("text")


SQL: dict[str, str] = {}
QUERIES = {"op7_quality": op7_quality}
