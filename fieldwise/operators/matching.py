"""Matching source columns to declared fields by signatures, profiles and aliases.

All inputs are header and dictionary inventories; no operator here reads a cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_header, normalise_header_native
from ..model import mapping_columns
from .common import dealt, first_per_key
from .seams import PROPOSALS, RANKINGS, answered

Proposer = Callable[[DataFrame], DataFrame]


def with_norm(df: DataFrame, text_column: str, name: str = "norm") -> DataFrame:
    """M1 over a frame: ASCII text folds JVM-side, only other text reaches the Arrow helper.

    A plain projection: no distinct, no join back, so a header most datasets share is no hot key.
    """
    text = F.col(text_column)
    plain = text.rlike(r"^[\x00-\x7f]*$")
    return df.withColumn(
        name, F.when(plain, normalise_header_native(text)).otherwise(normalise_header(F.when(~plain, text)))
    )


def column_signature(columns: DataFrame, normed: bool = False) -> DataFrame:
    """M2: dataset_id, column_signature. Order-independent; duplicates and blanks count."""
    headers = columns if normed else with_norm(columns, "header")
    return headers.groupBy("dataset_id").agg(
        F.sha2(F.to_json(F.array_sort(F.collect_list("norm"))), 256).alias("column_signature")
    )


def field_set_signature(fields: DataFrame) -> DataFrame:
    """M3: schema_name, signature over the declarations; descriptions and the set's name do not count."""
    one = F.to_json(
        F.struct(
            F.lower("name").alias("name"), "type", "unit", F.array_sort("allowed_values").alias("allowed_values"),
            "required", F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"), "date_format",
        ),
        {"ignoreNullFields": "false"},
    )
    return fields.groupBy("schema_name").agg(
        F.sha2(F.to_json(F.array_sort(F.collect_list(one))), 256).alias("signature")
    )


def with_occurrence(columns: DataFrame) -> DataFrame:
    """M4: rank of a header among equal normalised headers, left to right, and how many there are."""
    same = Window.partitionBy("dataset_id", "norm")
    return columns.withColumn("occurrence", F.row_number().over(same.orderBy("col_idx")) - 1).withColumn(
        "n_same", F.count("*").over(same)
    )


def find_profiles(signed: DataFrame, profiles: DataFrame) -> DataFrame:
    """M5: exact hits on (field_set_signature, column_signature); the pair is unique among profiles."""
    return signed.join(profiles, ["field_set_signature", "column_signature"])


def replay_profiles(hits: DataFrame, columns: DataFrame) -> DataFrame:
    """M6: the stored mapping on new headers, resolved by (normalised text, occurrence).

    hits: dataset_id, field_mappings array<struct<target_field, source_column_normalised,
    source_column_occurrence, inferred_value>>. A header that is not unique needs confirmation.
    """
    stored = hits.select("dataset_id", F.explode("field_mappings").alias("m")).select("dataset_id", "m.*")
    normed = dealt(with_norm(columns, "header").select("dataset_id", "col_idx", "header", "norm"), "dataset_id", "norm")
    named = with_occurrence(normed).select(
        "dataset_id", F.col("norm").alias("source_column_normalised"), F.col("occurrence").alias("source_column_occurrence"),
        "header", "n_same",
    )
    place = ["dataset_id", "source_column_normalised", "source_column_occurrence"]
    joined = dealt(stored, *place).join(dealt(named, *place), place, "left")
    unsure = F.coalesce(F.col("n_same") > 1, F.lit(False))
    reasoning = (
        F.when(unsure, "applied from a saved profile, but this header is not unique here; confirm the column")
        .when(F.col("header").isNull() & F.col("inferred_value").isNotNull(), F.concat(F.lit("saved profile supplies the constant '"), F.col("inferred_value"), F.lit("'")))
        .otherwise("applied from a saved profile")
    )
    return joined.select(*mapping_columns(
        source_column=F.col("header"), confidence=F.lit(1.0), reasoning=reasoning,
        needs_confirmation=unsure, inferred_value=F.col("inferred_value"),
    ))


def stored_mapping(mappings: DataFrame, columns: DataFrame) -> DataFrame:
    """The save side of M6: dataset_id, field_mappings as (normalised, occurrence) pairs."""
    places = with_occurrence(with_norm(columns, "header"))
    first = Window.partitionBy("dataset_id", "header").orderBy("col_idx")
    unique = places.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1).select(
        "dataset_id", F.col("header").alias("source_column"), "norm", "occurrence"
    )
    joined = mappings.join(unique, ["dataset_id", "source_column"], "left")
    entry = F.struct(
        "target_field", F.col("norm").alias("source_column_normalised"),
        F.coalesce("occurrence", F.lit(0)).alias("source_column_occurrence"), "inferred_value",
    )
    return joined.groupBy("dataset_id").agg(F.array_sort(F.collect_list(entry)).alias("field_mappings"))


def vendor_alias_index(aliases: DataFrame) -> DataFrame:
    """M8: vendor, norm -> field_name; a repeated key keeps its last field in (field_seq, seq) order."""
    normed = with_norm(aliases, "source_column").select("schema_name", "vendor", "norm", "field_name", "field_seq", "seq")
    last = first_per_key(normed, ["schema_name", "vendor", "norm"], [-F.col("field_seq"), -F.col("seq")])
    return last.select("schema_name", "vendor", "norm", "field_name")


def self_aliases(fields: DataFrame) -> DataFrame:
    """A field's own name, also with `_` and `-` read as spaces."""
    spaced = F.translate("name", "_-", "  ")
    return fields.select(
        "schema_name", F.col("name").alias("field_name"), F.explode(F.array("name", spaced)).alias("source_column")
    ).distinct()


def alias_index(fields: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """M9: schema_name, norm -> field_name; a spelling two fields claim maps to null."""
    known = self_aliases(fields)
    if aliases is not None:
        known = known.unionByName(aliases.select("schema_name", "field_name", "source_column"))
    claimed = with_norm(known.distinct(), "source_column").groupBy("schema_name", "norm").agg(
        F.min("field_name").alias("_least"), F.max("field_name").alias("_most")
    )
    return claimed.select("schema_name", "norm", F.when(F.col("_least") == F.col("_most"), F.col("_least")).alias("field_name"))


def covered_fields(columns: DataFrame, index: DataFrame) -> DataFrame:
    """dataset_id, schema_name, field_name, header: the left-most header claiming each field."""
    hits = with_norm(columns, "header").join(index.filter(F.col("field_name").isNotNull()), "norm")
    return (
        hits.groupBy("dataset_id", "schema_name", "field_name")
        .agg(F.min(F.struct("col_idx", "header")).alias("_m"))
        .select("dataset_id", "schema_name", "field_name", "_m.header")
    )


def prefill(columns: DataFrame, targets: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mappings at confidence one, uncovered (dataset_id, schema_name, target_field)).

    targets: dataset_id, schema_name, target_field, pos, the fields each dataset should fill.
    """
    covered = covered_fields(columns, index).withColumnRenamed("field_name", "target_field")
    key = ["dataset_id", "schema_name", "target_field"]
    mappings = targets.join(covered, key).select(*mapping_columns(
        source_column=F.col("header"), confidence=F.lit(1.0),
        reasoning=F.concat(F.lit("crosswalk alias '"), F.col("header"), F.lit("'")),
    ))
    return mappings, targets.join(covered, key, "left_anti")


def targets_for(datasets: DataFrame, fields: DataFrame) -> DataFrame:
    """The (dataset, field) pairs to fill; datasets carry a schema_name."""
    return datasets.select("dataset_id", "schema_name").join(
        fields.select("schema_name", F.col("name").alias("target_field"), "pos", F.coalesce("required", F.lit(True)).alias("required")),
        "schema_name",
    )


def resolve_mappings(
    columns: DataFrame,
    targets: DataFrame,
    index: DataFrame | None,
    replayed: DataFrame | None = None,
    proposer: Proposer | None = None,
    closure: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None,
    failures: list[DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(mappings, provenance). Profile first, else crosswalk, else the proposer for the rest.

    U1: `proposer` receives only uncovered (dataset, field) pairs and returns mapping rows; `closure`
    (M21 by default) keeps its answers honest. One that fails proposes nothing, and its error goes to `failures`. A layer is skipped by an anti-join, not by a driver check.
    """
    from .closures import close_proposals

    if replayed is None:
        remaining, layers = targets, []
        profiled = None
    else:
        profiled = replayed.select("dataset_id").distinct()
        kept = replayed.join(targets.select("dataset_id", "target_field"), ["dataset_id", "target_field"], "left_semi")
        layers = [kept.withColumn("_layer", F.lit("profile"))]
        remaining = targets.join(profiled, "dataset_id", "left_anti")
    if index is not None:
        filled, uncovered = prefill(columns, remaining, index)
        layers.append(filled.withColumn("_layer", F.lit("crosswalk")))
    else:
        uncovered = remaining
    answers = answered(proposer, uncovered, PROPOSALS, "the proposer", failures) if proposer is not None else None
    close = closure or close_proposals
    layers.append(close(answers, columns, uncovered).withColumn("_layer", F.lit("proposer")))
    merged = layers[0]
    for layer in layers[1:]:
        merged = merged.unionByName(layer)
    provenance = merged.groupBy("dataset_id").agg(
        F.count_if(F.col("_layer") == "profile").alias("_p"),
        F.count_if(F.col("_layer") == "crosswalk").alias("python_matched"),
        F.count_if((F.col("_layer") == "proposer") & F.col("source_column").isNotNull()).alias("proposer_matched"),
        F.count("*").alias("total"),
    ).select(
        "dataset_id",
        F.when(F.col("_p") > 0, "auto-applied-from-profile")
        .when(F.col("python_matched") == F.col("total"), "pre-filled-from-crosswalk")
        .when(F.col("python_matched") > 0, "crosswalk-and-proposer")
        .otherwise("proposer")
        .alias("provenance"),
        "python_matched", "proposer_matched", "total",
    )
    return merged.drop("_layer"), provenance


def escalation(provenance: DataFrame) -> DataFrame:
    """How many fields the dictionary settled and how many were handed on."""
    return provenance.select("dataset_id", "python_matched", (F.col("total") - F.col("python_matched")).alias("escalated"), "total")


def score_schemas(columns: DataFrame, fields: DataFrame, index: DataFrame, replayed: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """dataset_id, schema_name, source, matched map, uncovered, total, score, rank.

    replayed: dataset_id, schema_name, field_name, header from profile hits; it outranks any crosswalk.
    Schemas without coverage do not appear. Coverage comes from an equi-join on spellings, so a
    dataset meets only the schemas it shares a spelling with. The score is a count of its own: where nothing
    asks for the matched map, no list is made and no header is moved.
    """
    cross = covered_fields(columns, index).withColumn("source", F.lit("crosswalk"))
    if replayed is not None:
        learned = replayed.select("dataset_id", "schema_name", "field_name", "header").withColumn("source", F.lit("profile"))
        cross = cross.join(learned.select("dataset_id", "schema_name").distinct(), ["dataset_id", "schema_name"], "left_anti").unionByName(learned)
    declared = fields.groupBy("schema_name").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("_declared"), F.count("*").alias("total")
    )
    scored = (
        cross.groupBy("dataset_id", "schema_name", "source")
        .agg(F.array_sort(F.collect_list(F.struct("field_name", "header"))).alias("_pairs"), F.count("*").alias("_n"))
        .join(declared, "schema_name")
        .withColumn("_names", F.transform("_pairs", lambda p: p["field_name"]))
        .select(
            "dataset_id", "schema_name", "source", F.map_from_entries("_pairs").alias("matched"),
            F.array_except(F.transform("_declared", lambda d: d["name"]), F.col("_names")).alias("uncovered"),
            "total",
            F.when(F.col("total") == 0, 0.0).otherwise(F.col("_n") / F.col("total")).alias("score"),
        )
    )
    order = [F.when(F.col("source") == "profile", 0).otherwise(1), F.col("score").desc(), F.col("schema_name")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("dataset_id").orderBy(*order)))


def rank_unmatched(datasets: DataFrame, scored: DataFrame, schemas: DataFrame, ranker: Proposer | None, failures: list[DataFrame] | None = None) -> DataFrame:
    """The ranker's one suggestion for datasets no schema covers; without a ranker, or from one that fails, none."""
    from .closures import close_rankings

    empty_hands = datasets.select("dataset_id").join(scored.select("dataset_id").distinct(), "dataset_id", "left_anti")
    if ranker is None:
        return empty_hands.limit(0).select("dataset_id", F.lit(None).cast("string").alias("schema_name"), F.lit(None).cast("string").alias("reason"))
    return close_rankings(answered(ranker, empty_hands, RANKINGS, "the schema ranker", failures), schemas).filter(F.col("rank") == 1).select("dataset_id", "schema_name", "reason")


def preselect(scored: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """dataset_id, tie, preselected. A tie at the top preselects nothing.

    defaults: dataset_id, default_schema, readable; used where nothing scored and the shape is readable.
    """
    top = scored.filter(F.col("rank") <= 2).groupBy("dataset_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("schema_name"))).alias("_first"),
        F.max(F.when(F.col("rank") == 1, F.struct("source", "score"))).alias("_a"),
        F.max(F.when(F.col("rank") == 2, F.struct("source", "score"))).alias("_b"),
    )
    tie = F.coalesce(
        (F.col("_a.score") == F.col("_b.score")) & ((F.col("_a.source") == "profile") == (F.col("_b.source") == "profile")),
        F.lit(False),
    )
    judged = top.select("dataset_id", tie.alias("tie"), F.when(~tie, F.col("_first")).alias("preselected"))
    if defaults is None:
        return judged
    joined = defaults.join(judged, "dataset_id", "left")
    fallback = F.when(F.col("tie").isNull() & F.col("readable"), F.col("default_schema"))
    return joined.select("dataset_id", F.coalesce("tie", F.lit(False)).alias("tie"), F.coalesce("preselected", fallback).alias("preselected"))


def recall_vendor(columns: DataFrame, profile_vendors: DataFrame | None, aliases: DataFrame | None) -> DataFrame:
    """dataset_id, vendor, source, candidates. Two vendors that fit are named, never picked.

    profile_vendors: dataset_id, vendor of a profile hit. aliases: live (vendor, source_column).
    """
    datasets = columns.select("dataset_id").distinct()
    if aliases is None:
        found = datasets.withColumn("_vendors", F.array().cast("array<string>"))
    else:
        known = with_norm(aliases.select("vendor", "source_column").distinct(), "source_column").select("vendor", "norm").distinct()
        seen = with_norm(columns, "header").select("dataset_id", "norm").distinct()
        found = datasets.join(
            seen.join(known, "norm").groupBy("dataset_id").agg(F.array_sort(F.collect_set("vendor")).alias("_vendors")),
            "dataset_id", "left",
        )
    if profile_vendors is None:
        joined = found.withColumn("_learned", F.lit(None).cast("string"))
    else:
        joined = found.join(
            profile_vendors.filter(F.col("vendor").isNotNull()).select("dataset_id", F.col("vendor").alias("_learned")), "dataset_id", "left"
        )
    n = F.coalesce(F.size("_vendors"), F.lit(0))
    only = F.when(n == 1, F.element_at("_vendors", 1))
    none = F.array().cast("array<string>")
    return joined.select(
        "dataset_id", F.coalesce("_learned", only).alias("vendor"),
        F.when(F.col("_learned").isNotNull(), "profile").when(n == 1, "crosswalk").alias("source"),
        F.when(F.col("_learned").isNull() & (n >= 2), F.col("_vendors")).otherwise(none).alias("candidates"),
    )


def field_set_from_schema(fields: DataFrame) -> DataFrame:
    """The live fields of every schema as declarations, in declared order."""
    live = fields.filter(F.col("removed_at").isNull())
    return live.withColumn("pos", F.row_number().over(Window.partitionBy("schema_name").orderBy("seq")) - 1).select(
        "schema_name", "pos", "name", "description", "type", "allowed_values", "unit", "required", "min", "max", "date_format"
    )


def replay_hints(questions: DataFrame, profiles: DataFrame, grid: DataFrame) -> DataFrame:
    """M7: for sheets with an open question, the first saved hint that reproduces its own signature.

    questions: file_id, sheet, field_set_signature. profiles: with structural_hint.header_row.
    A hint is tried only against the one grid row it names, found by an equi-join on that row.
    """
    hinted = profiles.filter(F.col("structural_hint.header_row").isNotNull()).select(
        "field_set_signature", "column_signature", "profile_id", "created_at",
        F.col("structural_hint.header_row").alias("row_idx"), "structural_hint",
    )
    asked = questions.join(hinted, "field_set_signature")
    named = asked.join(grid.select("file_id", "sheet", "row_idx", "cells"), ["file_id", "sheet", "row_idx"])
    texts = named.select("file_id", "sheet", "row_idx", F.posexplode("cells").alias("col_idx", "c")).distinct()
    normed = with_norm(
        texts.select("file_id", "sheet", "row_idx", "col_idx", F.coalesce(F.trim("c.v"), F.lit("")).alias("header")), "header"
    )
    signatures = normed.groupBy("file_id", "sheet", "row_idx").agg(
        F.sha2(F.to_json(F.array_sort(F.collect_list("norm"))), 256).alias("_signature")
    )
    hits = asked.join(signatures, ["file_id", "sheet", "row_idx"]).filter(F.col("_signature") == F.col("column_signature"))
    order: list[Column] = [F.col("created_at"), F.col("profile_id")]
    rank = F.row_number().over(Window.partitionBy("file_id", "sheet", "field_set_signature").orderBy(*order))
    return hits.withColumn("_r", rank).filter(F.col("_r") == 1).select(
        "file_id", "sheet", "field_set_signature", "column_signature", "profile_id", F.col("row_idx").alias("header_row")
    )
