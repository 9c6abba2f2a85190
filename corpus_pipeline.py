"""A corpus pipeline: language ID, exact dedup, near-duplicate removal, mixing by source, tokenisation.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before kept; all but the last return the columns
of documents. run() writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ropewalk.llm.bpe import round_trip
from ropewalk.llm.common import held_out, unstash
from ropewalk.llm.exact_dedup import keep_first
from ropewalk.llm.langid import UNKNOWN, identify, train_on
from ropewalk.llm.mixing import mixed_rows
from ropewalk.llm.simhash import keep_one
from ropewalk.plans.tables import settled

#: Documents whose likeliest language is less likely than this are rejected, as those without a letter are.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the network knows. It learns from their lang, but for a quarter held out.

    Null and empty texts and texts without a letter go. Without a labelled text nothing is known and all go. Null and
    repeated ids are rows like others; an empty table gives an empty result.
    """
    found = identify(docs, train_on(docs, ~held_out("doc_id", 4, 2)))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z lower-cased; null is empty) the one with the largest doc_id.

    Null ids lose to others; of rows with one id and text any one stays; an empty table gives an empty result.
    """
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the one with the smallest doc_id, null last; of repeated rows any one.

    Texts without words have the fingerprint zero and are near-duplicates of each other; an empty table gives an
    empty result.
    """
    return keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it doesn't take go.

    A null source is a source; null and repeated ids are told apart as far as the targets need; texts without words
    weigh nothing; an empty table gives an empty result.
    """
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: null texts count as empty, repeated rows come as often."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, block=4 << 20)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mix", mixed),
    ("bpe", tokens),
]

#: No SQL for the language network and the fingerprints: tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is removed when the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settled(partial(stage, spark, docs, sf_dir))
        unstash(before)
    return STAGES[-1][1](spark, docs, sf_dir)
