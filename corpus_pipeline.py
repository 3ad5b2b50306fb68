"""A training corpus from ``documents``: quality rules, exact and near deduplication, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of the stage before it; all but the
last return the columns of ``documents``.  The result of a stage must be written before the next
stage is called: a stage's scratch tables go when the next one starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelyard.llm import exact_dedup, jaccard_join, packing, quality_rules, secret_scan
from voxelyard.llm.common import materialize, release, scratch_mark, table
from voxelyard.llm.queries import tokenizer_path

_held: tuple[int, int] | None = None


def _stage(make: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Frees what the stage before it left in the shared folder."""

    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _held
        if _held and _held[1] == scratch_mark():
            release(spark, *_held)
        mark = scratch_mark()
        out = make(spark, docs, sf_dir)
        _held = (mark, scratch_mark())
        return out

    return stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_repeats(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the least id."""
    return jaccard_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets redacted and n_chars brought up to date."""
    return secret_scan.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", _stage(quality)),
    ("exact_dedup", _stage(exact)),
    ("jaccard_join", _stage(near)),
    ("secret_scan", _stage(secrets)),
    ("packing", _stage(pack)),
]

#: Tokenising and the robust estimates have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}", keep=True)
    return docs
