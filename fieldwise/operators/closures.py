"""Closures over answers from outside: proposals, rankings, drafts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..model import mapping_columns
from .common import dealt, first_per_key
from .seams import DRAFTS, answered


def close_proposals(proposals: DataFrame | None, columns: DataFrame, targets: DataFrame) -> DataFrame:
    """Exactly one mapping row per wanted (dataset, field).

    Silence is a flagged row at confidence zero; a column the dataset does not have is flagged;
    an optional field that nothing supplies is cleared. Of repeated answers the one with the greatest
    `position` counts; without that column, the least by text.
    """
    key = ["dataset_id", "target_field"]
    wanted = targets.select(*key, F.coalesce("required", F.lit(True)).alias("_required"))
    if proposals is None:
        joined = wanted.select(
            *key, "_required", F.lit(False).alias("_answered"),
            F.lit(None).cast("string").alias("source_column"), F.lit(None).cast("double").alias("confidence"),
            F.lit(None).cast("string").alias("reasoning"), F.lit(None).cast("boolean").alias("needs_confirmation"),
            F.lit(None).cast("string").alias("inferred_value"),
            F.lit(None).cast("array<struct<source_column:string,confidence:double>>").alias("alternatives"),
            F.lit(None).cast("boolean").alias("_real"),
        )
    else:
        given = proposals.select(*key, "source_column", "confidence", "reasoning", "needs_confirmation", "inferred_value", "alternatives", *(["position"] if "position" in proposals.columns else []))
        last = first_per_key(given, key, [-F.col("position")] if "position" in given.columns else []).drop("position")
        real = columns.select("dataset_id", F.col("header").alias("source_column")).distinct().withColumn("_real", F.lit(True))
        joined = wanted.join(last.withColumn("_answered", F.lit(True)), key, "left").join(real, ["dataset_id", "source_column"], "left")
    answered = F.coalesce(F.col("_answered"), F.lit(False))
    invented = F.col("source_column").isNotNull() & F.col("_real").isNull()
    absent = F.col("source_column").isNull() & F.col("inferred_value").isNull()
    cleared = ~F.col("_required") & absent
    note = F.concat(F.coalesce("reasoning", F.lit("")), F.lit(" [flagged: this dataset has no column '"), F.col("source_column"), F.lit("']"))
    return joined.select(*mapping_columns(
        source_column=F.col("source_column"),
        confidence=F.coalesce("confidence", F.lit(0.0)),
        reasoning=F.when(~answered, "no mapping was proposed for this field").when(invented, note).otherwise(F.col("reasoning")),
        needs_confirmation=F.when(cleared, False).when(~answered | invented, True).otherwise(F.coalesce("needs_confirmation", F.lit(True))),
        inferred_value=F.col("inferred_value"),
        alternatives=F.coalesce("alternatives", F.array().cast("array<struct<source_column:string,confidence:double>>")),
    ))


def close_rankings(rankings: DataFrame, schemas: DataFrame) -> DataFrame:
    """Known schemas only, first mention kept, ranks contiguous from one.

    rankings: dataset_id, position, schema_name, reason.
    """
    governed = rankings.join(schemas.select("schema_name").distinct(), "schema_name", "left_semi")
    kept = first_per_key(governed, ["dataset_id", "schema_name"], ["position"])
    rank = F.row_number().over(Window.partitionBy("dataset_id").orderBy("position"))
    return kept.select("dataset_id", "schema_name", "reason", rank.alias("rank"))


def close_drafts(drafts: DataFrame, columns: DataFrame) -> DataFrame:
    """Usable draft fields in proposed order; header text is read back by index.

    drafts: dataset_id, position, column_index, name, type, required, reason. One ordered pass per
    dataset (a draft is at most a field list): an entry dropped for one reason reserves nothing.
    """
    widths = columns.groupBy("dataset_id").agg(F.count("*").alias("_width"))
    entry = F.struct("position", "column_index", strip(F.col("name")).alias("name"), "type", "required", "reason")
    lists = dealt(drafts, "dataset_id").groupBy("dataset_id").agg(F.array_sort(F.collect_list(entry)).alias("_drafts")).join(widths, "dataset_id")
    kind = lists.schema["_drafts"].dataType.simpleString()

    def step(kept, d):
        taken = F.exists(kept, lambda k: (k["column_index"] == d["column_index"]) | (k["name"] == d["name"]))
        usable = (d["column_index"] >= 0) & (d["column_index"] < F.col("_width")) & (d["name"] != "") & ~taken
        return F.when(F.coalesce(usable, F.lit(False)), F.concat(kept, F.array(d))).otherwise(kept)

    kept = lists.select("dataset_id", F.explode(F.aggregate("_drafts", F.array().cast(kind), step)).alias("d")).select("dataset_id", "d.*")
    headers = columns.select("dataset_id", F.col("col_idx").alias("column_index"), F.col("header").alias("source_header"))
    place = ["dataset_id", "column_index"]
    return dealt(kept, *place).join(dealt(headers, *place), place).select(
        "dataset_id", "position", "source_header", "name", "type", "required", "reason"
    )


def draft_schemas(
    undecided: DataFrame,
    columns: DataFrame,
    sample: DataFrame | None,
    drafter: Callable[[DataFrame, DataFrame | None], DataFrame],
    failures: list[DataFrame] | None = None,
) -> DataFrame:
    """U4: draft fields for datasets no schema fits.

    The drafter sees headers, plus at most five sample rows unless `sample` is withheld (headers only). One that fails drafts nothing.
    """
    wanted = columns.join(undecided.select("dataset_id").distinct(), "dataset_id", "left_semi")
    shown = None if sample is None else sample.join(undecided.select("dataset_id").distinct(), "dataset_id", "left_semi")
    return close_drafts(answered(lambda asked: drafter(asked, shown), wanted, DRAFTS, "the schema drafter", failures), columns)
