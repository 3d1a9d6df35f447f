"""The corpus pipeline: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next
one's documents. All but the last return the columns of `documents`. Null and empty texts are rejected by the quality rules, so they go; equal
ids with different texts are different documents; an empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwise.llm import bpe, decontaminate, jaccard_join, line_rules, rule_ensemble
from fieldwise.llm.common import id_remainder, settled, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3, learned from the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(id_remainder(F.col("doc_id"), 5) != 0)
    return rule_ensemble.keep_good(docs, rule_ensemble.train_on(docs, labels), 0.3)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep enough words without the lines their source repeats, those lines removed."""
    return line_rules.clean_documents(docs)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor one with other names and numbers."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, decoded again: their number and digests."""
    coded = bpe.round_trip(docs.select("doc_id", "text"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard),
    ("decontamination", decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

# The first stage fits a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, one behind the other."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
