"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, piece encoding, each over all its predecessor kept.

A stage takes (spark, docs, sf_dir) and gives a DataFrame, which run() writes as Parquet and reads again for the next.
The stages fit models, hash and search, so SQL can't express the rows of run(); tests hold them against brute force,
stage by stage.

Edge cases, as the stages' operators define them: null and empty texts score the toxicity model's bias, equal each other in
both dedups, stand once in the mix and have no pieces. Rows with a null doc_id have no label and give way to rows that
have one. Repeated rows are copies. Texts of any length are read whole. Extra columns are handed on by all stages but the
last, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lociflow.llm import exact_dedup, mixing, near_dedup, pieces, toxicity
from lociflow.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the factorization machine, fitted on the labels, rejects."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the target weights takes it, the last of a source's cut at its budget."""
    return mixing.mixed(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the pieces of the text with its N best segmentations."""
    return pieces.encode(docs.select("doc_id", "lang", "source", "text")).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", to_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
