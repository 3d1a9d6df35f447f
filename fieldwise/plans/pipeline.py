"""The operators composed: map a corpus, review it, confirm it, reconcile a dictionary.

Inventories that several stages read (annotated columns, mappings, formats, checked mappings) are
settled in the checkpoint folder; data rows never are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FieldSet, Tables
from ..operators.changes import Dictionary, apply_changes, changeset
from ..operators.closures import close_proposals
from ..operators.convert import assemble, bind, require_date_answers, resolve_date_formats
from ..operators.dictionary import alias_view, import_master_map, master_map_aliases, read_master_maps
from ..operators.evidence import annotate_locales, resolve_locales
from ..operators.matching import (
    Proposer, alias_index, column_signature, field_set_signature, find_profiles, replay_profiles, resolve_mappings,
    targets_for, vendor_alias_index, with_norm,
)
from ..operators.reconcile import detect_conflicts, override_index, reconcile_map, undecided
from ..operators.seams import PROPOSALS, answered
from ..operators.validate import check_coverage, field_counts, judge, readiness, validate
from ..session import settle
from ..sinks.export import manifests


class Review(NamedTuple):
    """Everything a reviewer sees; all frames lazy."""

    columns: DataFrame
    mappings: DataFrame
    provenance: DataFrame
    readiness: DataFrame
    formats: DataFrame
    locale_questions: DataFrame
    date_questions: DataFrame
    contradictions: DataFrame
    errors: DataFrame
    verdicts: DataFrame | None = None


def date_formats(tables: Tables, columns: DataFrame, mappings: DataFrame, field_set: FieldSet, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C12, or three empty frames without any scan where no declared field is a date."""
    spark = tables.rows.sparkSession
    if any(f.type == "date" for f in field_set.fields):
        return resolve_date_formats(tables.rows, columns, mappings, field_set.frame(spark), answers)
    key = "dataset_id string, target_field string"
    return (
        spark.createDataFrame([], f"{key}, date_format string"),
        spark.createDataFrame([], f"{key}, source_column string, day_first_format string, month_first_format string, example_values array<string>, ambiguous_row_count bigint"),
        spark.createDataFrame([], f"{key}, declared_format string, example_value string"),
    )


def signatures(columns: DataFrame, fields: DataFrame, datasets: DataFrame) -> DataFrame:
    """dataset_id, schema_name, field_set_signature, column_signature."""
    return (
        datasets.select("dataset_id", "schema_name")
        .join(field_set_signature(fields).withColumnRenamed("signature", "field_set_signature"), "schema_name")
        .join(column_signature(columns), "dataset_id")
    )


def map_corpus(
    tables: Tables,
    field_set: FieldSet,
    aliases: DataFrame | None = None,
    profiles: DataFrame | None = None,
    hints: DataFrame | None = None,
    date_answers: DataFrame | None = None,
    proposer: Proposer | None = None,
    strictness: str = "strict",
) -> Review:
    """Map every dataset of a corpus onto one declared field set and check every value.

    The ladder per dataset: saved profile, crosswalk aliases, proposer, and what is left is flagged.
    """
    spark = tables.rows.sparkSession
    fields = field_set.frame(spark)
    datasets = tables.datasets.withColumn("schema_name", F.lit(field_set.name))
    annotated = settle(annotate_locales(tables.columns, tables.rows))
    columns, locale_questions, hint_errors = resolve_locales(annotated, hints)
    targets = targets_for(datasets, fields)
    replayed = None
    if profiles is not None:
        hits = find_profiles(signatures(tables.columns, fields, datasets), profiles)
        replayed = replay_profiles(hits, tables.columns)
    failures: list[DataFrame] = []
    mappings, provenance = resolve_mappings(tables.columns, targets, alias_index(fields, aliases), replayed, proposer, failures=failures)
    mappings = settle(mappings)
    formats, conflicts, contradictions = date_formats(tables, columns, mappings, field_set, date_answers)
    errors = hint_errors
    for failed in failures:
        errors = errors.unionByName(failed.select(F.lit(None).cast("string").alias("dataset_id"), "error"))
    if date_answers is not None:
        errors = errors.unionByName(require_date_answers(conflicts, date_answers))
    judged = judge(mappings, columns, tables.rows, fields, formats, contradictions, strictness, "review")
    checked = settle(judged.mappings)
    return Review(columns, checked, provenance, readiness(checked, datasets), formats, locale_questions, conflicts, contradictions, errors, judged.verdicts)


class Confirmed(NamedTuple):
    tidy: DataFrame
    manifests: DataFrame
    rejected: DataFrame
    mappings: DataFrame


def confirm(
    tables: Tables,
    columns: DataFrame,
    edited: DataFrame,
    field_set: FieldSet,
    exported_at: Column,
    confirmed_by: str | None = None,
    vendor: str | None = None,
    provenance: DataFrame | None = None,
    date_answers: DataFrame | None = None,
    strictness: str = "strict",
) -> Confirmed:
    """The server-side gate over edited mappings.

    Readiness is recomputed from the values; a claim in the edited rows is only ever made stricter.
    A rejected dataset yields its reasons and no record.
    """
    spark = tables.rows.sparkSession
    fields = field_set.frame(spark)
    gaps = check_coverage(edited, field_set.names, tables.datasets)
    complete = settle(edited.join(gaps.select("dataset_id").distinct(), "dataset_id", "left_anti"))
    formats, conflicts, contradictions = date_formats(tables, columns, complete, field_set, date_answers)
    checked = settle(validate(complete, columns, tables.rows, fields, formats, contradictions, strictness, "confirm"))
    gate = readiness(checked, tables.datasets)
    open_dates = conflicts.select("dataset_id", F.concat(F.lit("date order undecided: "), F.col("target_field")).alias("reason"))
    unready = gate.filter(~F.col("ready")).select(
        "dataset_id", F.concat(F.lit("needs confirmation: "), F.array_join("unclear_fields", ", ")).alias("reason")
    )
    uncovered = gaps.select("dataset_id", F.concat_ws(" ", F.col("problem"), F.lit("field:"), F.col("target_field")).alias("reason"))
    rejected = uncovered.unionByName(unready.join(uncovered.select("dataset_id").distinct(), "dataset_id", "left_anti")).unionByName(open_dates)
    passed = gate.filter("ready").select("dataset_id").join(open_dates.select("dataset_id").distinct(), "dataset_id", "left_anti")
    good = checked.join(passed, "dataset_id", "left_semi")
    tidy = assemble(tables.rows, bind(good, columns, fields, formats), field_set, tables.datasets)
    datasets = tables.datasets.join(passed, "dataset_id", "left_semi").withColumn("schema_name", F.lit(field_set.name))
    audit = signatures(columns, fields, datasets).select(
        "dataset_id", "schema_name", F.lit(vendor).cast("string").alias("vendor"), F.lit(confirmed_by).cast("string").alias("confirmed_by"),
        exported_at.alias("exported_at"), F.lit(strictness).alias("strictness"), "field_set_signature", "column_signature",
    )
    if provenance is None:
        audit = audit.withColumn("provenance", F.lit("confirmed"))
    else:
        audit = audit.join(provenance.select("dataset_id", "provenance"), "dataset_id", "left")
    return Confirmed(tidy, manifests(datasets, columns, good, audit), rejected, good)


class Reconciled(NamedTuple):
    conflicts: DataFrame
    undecided: DataFrame
    mappings: DataFrame
    readiness: DataFrame


def reconcile(
    tables: Tables,
    field_set: FieldSet,
    master: DataFrame,
    incoming: DataFrame,
    vendors: DataFrame,
    choices: DataFrame | None = None,
    proposer: Proposer | None = None,
) -> Reconciled:
    """Conflicts become questions; without an open one, the vendor's aliases map its datasets.

    master and incoming: schema_name, vendor, source_column, field_name, field_seq, seq.
    While a conflict is undecided every dataset of that vendor stays unmapped.
    """
    spark = tables.rows.sparkSession
    fields = field_set.frame(spark)
    columns = settle(annotate_locales(tables.columns, tables.rows))
    conflicts = detect_conflicts(incoming, master)
    remaining = conflicts if choices is None else undecided(conflicts, choices)
    overrides = None if choices is None else settle(override_index(choices, master, incoming))
    held = remaining.select("vendor").distinct()
    free = settle(vendors.join(held, "vendor", "left_anti"))
    both = master.unionByName(incoming.withColumn("field_seq", F.lit(-1)).select(*master.columns))
    targets = targets_for(tables.datasets.join(free, "dataset_id", "left_semi").withColumn("schema_name", F.lit(field_set.name)), fields)
    filled, uncovered = reconcile_map(tables.columns, targets, vendor_alias_index(both), overrides, free)
    answers = answered(proposer, uncovered, PROPOSALS, "the proposer", None) if proposer is not None else None
    mappings = settle(filled.unionByName(close_proposals(answers, tables.columns, uncovered)))
    formats, _, contradictions = date_formats(tables, columns, mappings, field_set)
    checked = validate(mappings, columns, tables.rows, fields, formats, contradictions)
    return Reconciled(conflicts, remaining, checked, readiness(checked, tables.datasets))


class Imported(NamedTuple):
    """A reconciled import: what it asks, what it changes, and the mappings of this run."""

    conflicts: DataFrame  # map_id, vendor, source_column, norm, master_field, map_file_field
    undecided: DataFrame
    errors: DataFrame  # map_id, error
    changes: DataFrame  # a changeset; apply it with `apply_changes`
    mappings: DataFrame
    provenance: DataFrame  # dataset_id, provenance
    readiness: DataFrame


RECONCILED = "reconciled-from-crosswalk"


def reconcile_import(
    tables: Tables,
    field_set: FieldSet,
    dictionary: Dictionary,
    target_schema_id: str,
    envelopes: DataFrame,
    vendors: DataFrame,
    imported_at: Column,
    choices: DataFrame | None = None,
    proposer: Proposer | None = None,
    strictness: str = "strict",
) -> Imported:
    """R5 with G16: map files (map_id, envelope) reconciled with the dictionary, imported, and the vendors' datasets mapped from the result.

    Conflicts come before anything is written. A map with an undecided conflict changes nothing, and the vendors it disagrees on stay unmapped. Other
    maps add what the dictionary lacks; stored rows and their provenance stay. A decision holds for this run's mappings only and is never stored.
    """
    spark = tables.rows.sparkSession
    fields = field_set.frame(spark)
    of_target = F.col("schema_id") == target_schema_id
    known = Dictionary(dictionary.schemas.filter(of_target), dictionary.fields.filter(of_target), dictionary.aliases)
    master = settle(alias_view(*known))
    map_fields, errors = read_master_maps(envelopes)
    incoming = settle(master_map_aliases(map_fields))
    asked = with_norm(incoming, "source_column").select("map_id", "vendor", "norm", F.col("field_name").alias("map_file_field")).distinct()
    conflicts = settle(detect_conflicts(incoming, master).distinct().join(asked, ["vendor", "norm", "map_file_field"]).select("map_id", "vendor", "source_column", "norm", "master_field", "map_file_field"))
    remaining = conflicts if choices is None else settle(undecided(conflicts, choices))
    overrides = None if choices is None else settle(override_index(choices, master, incoming))

    free_maps = envelopes.join(remaining.select("map_id").distinct(), "map_id", "left_anti")
    next_fields, next_aliases, _ = import_master_map(dictionary.fields, dictionary.aliases, target_schema_id, free_maps, imported_at)
    changes = settle(changeset(dictionary, Dictionary(dictionary.schemas, next_fields, next_aliases)))
    merged = apply_changes(dictionary, changes)

    free = settle(vendors.join(remaining.select("vendor").distinct(), "vendor", "left_anti"))
    index = vendor_alias_index(alias_view(merged.schemas.filter(of_target), merged.fields, merged.aliases))
    targets = targets_for(tables.datasets.join(free, "dataset_id", "left_semi").withColumn("schema_name", F.lit(field_set.name)), fields)
    filled, uncovered = reconcile_map(tables.columns, targets, index, overrides, free)
    answers = answered(proposer, uncovered, PROPOSALS, "the proposer", None) if proposer is not None else None
    mappings = settle(filled.unionByName(close_proposals(answers, tables.columns, uncovered)))
    columns = settle(annotate_locales(tables.columns, tables.rows))
    formats, _, contradictions = date_formats(tables, columns, mappings, field_set)
    checked = settle(validate(mappings, columns, tables.rows, fields, formats, contradictions, strictness))
    provenance = free.select("dataset_id", F.lit(RECONCILED).alias("provenance")).distinct()
    return Imported(conflicts, remaining, errors, changes, checked, provenance, readiness(checked, tables.datasets))


def field_report(review: Review, tables: Tables, field_set: FieldSet) -> DataFrame:
    """One row per (dataset, field): what was mapped, how it reads, what failed, whether the dataset may leave.

    The counts are those of the review's own pass, or of one more where it read only the first rows.
    """
    fields = field_set.frame(tables.rows.sparkSession)
    bound = bind(review.mappings, review.columns, fields, review.formats)
    counts = field_counts(tables.rows, bound, review.verdicts)
    key = ["dataset_id", "target_field"]
    return (
        bound.select(*key, "source_column", "locale", "needs_confirmation")
        .join(counts, key, "left")
        .join(review.readiness.select("dataset_id", "ready"), "dataset_id")
        .join(tables.datasets.select("dataset_id", "source_file"), "dataset_id")
        .select(
            F.col("source_file").alias("dataset"), "target_field", "source_column", "locale",
            F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("converted", F.lit(0)).alias("converted"),
            F.coalesce("violations", F.lit(0)).alias("violations"), "needs_confirmation", "ready",
        )
    )
