"""A corpus pipeline of five stages over documents.

Each stage works on all that the one before it kept and returns the columns of documents; the last returns token ids.
Between stages the rows are written to the shared folder and read again, so a lost executor costs one stage at most.
SQL expresses neither a fitted language model nor byte-pair merges, so there is no oracle; tests/llm holds each stage
against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import bpe, decontaminate, lang_id, near_dedup, passage_dedup
from sievewright.llm.common import read, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found stay."""
    return lang_id.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of five words, similarity 0.8."""
    return near_dedup.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay in the first document that has them."""
    return passage_dedup.clean(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go, and documents that are mostly such."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit), their number, and whether they decode to the text's bytes."""
    found = bpe.round_trip(docs, keep=("doc_id", "text"))
    same = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")
    return found.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("decodes"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
