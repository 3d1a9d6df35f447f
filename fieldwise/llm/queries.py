"""The queries over the given tables, one for each operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, filter_audit, jaccard_join, language, licenses, line_rules, rule_ensemble, shards, suffix_tree, url_filter, whitening
from .common import id_remainder, settled, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    profiles = language.prototypes(docs.filter(~held_out).select("text", "lang"))
    found = language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), profiles, keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the 50k byte-level ranks and decoded again, as digests."""
    coded = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards whose row counts differ by one at most."""
    text = F.col("text").cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("text_crc32"),
    )
    return shards.shuffle_into_shards(rows, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by rules and vocabulary."""
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", *(f"url_verdict.{c}" for c in ("host", "path", "rule", "strict_terms", "soft_terms", "verdict")))


def op5_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base score and suffix-tree score, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    model, counts = suffix_tree.train(docs.filter(~held_out).select("text"))
    return suffix_tree.score(docs, model, counts, keep={"doc_id": F.col("doc_id"), "held_out": held_out})


def op6_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, or one with other names and numbers."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts, and whether it stays once the lines that its source repeats are gone."""
    judged = line_rules.judge_lines(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return judged.select("doc_id", *line_rules.BASE, "removed_words", "base_failed", "kept")


def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned from the labels outside the held-out fold."""
    docs, stats = rule_ensemble.with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = settled(docs.select("doc_id", stats), "statistics")  # a row of numbers a document, read for training and for scoring
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(id_remainder(F.col("doc_id"), 5) != 0)
    model = rule_ensemble.fit(docs.join(labels, "doc_id"), stats, "quality")
    scored = docs.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), model.score(stats).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_license_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and the licenses whose texts or notices it holds."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op10_shingle_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component its near copies form: four-word shingles, 85 of 100."""
    found = jaccard_join.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, similar=85, of=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op11_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, as digests of what is read back from the formatted text and its loss spans."""
    return chat.digests(chat.format_conversations(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes in each order of the five filters, for each source."""
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding along its first 16 whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_hyperdimensional_language, op2_bpe_round_trip, op3_hypergeometric_shards, op4_url_vocabulary, op5_suffix_tree_score, op6_template_leaks, op7_line_frequency, op8_rule_ensemble, op9_license_positions, op10_shingle_links, op11_relational_chat, op12_filter_audit, op13_embedding_whitening)
}

ORACLES: dict[str, str] = {"op4_url_vocabulary": url_filter.oracle(), "op7_line_frequency": line_rules.oracle(), "op10_shingle_links": jaccard_join.oracle(4, 85, 100), "op11_relational_chat": chat.oracle(), "op12_filter_audit": filter_audit.oracle()}
