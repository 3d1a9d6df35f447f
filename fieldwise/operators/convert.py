"""Typed conversion and canonical assembly.

Rows are never exploded or pivoted to assemble: each dataset's mapping becomes one
small record of column positions, joined to its rows, and every target field is a
projection over the row's own cells. A data row is moved at most once, by that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..functions.text import strip
from ..model import SOURCE_SHEET, Field, FieldSet
from ..session import settle
from .evidence import classify_date_order, example_values, parses_all

SPARK_TYPES = {"number": "double", "integer": "bigint", "date": "date", "text": "string", None: "string"}


def to_number(v: Column, locale: Column) -> tuple[Column, Column]:
    """(double, flagged)."""
    parsed = numbers.parse_number(v, locale)
    return parsed, numbers.number_flag(v, locale, parsed)


def to_integer(v: Column, locale: Column) -> tuple[Column, Column]:
    """(bigint, flagged)."""
    parsed, flagged = to_number(v, locale)
    narrowed = numbers.narrow_to_long(parsed)
    return narrowed, flagged | (parsed.isNotNull() & narrowed.isNull())


def to_date_field(v: Column, resolved: Column, declared: Column) -> tuple[Column, Column]:
    """(date, flagged). The resolved format wins over the declared one; no format always flags."""
    value = dates.convert_date(v, F.coalesce(resolved, declared))
    return value, v.isNotNull() & value.isNull()


def unit_mismatch(v: Column, kind: Column, unit: Column) -> Column:
    """Only where the cell itself is the unit; the value is never changed."""
    checked = kind.isNull() | (kind == "text")
    return checked & unit.isNotNull() & v.isNotNull() & (strip(v) != unit)


def value_source(source_column: Column, inferred_value: Column) -> Column:
    """A named column wins over an inferred value."""
    return F.when(source_column.isNotNull(), "column").when(inferred_value.isNotNull(), "inferred").otherwise("absent")


def header_positions(columns: DataFrame) -> DataFrame:
    """The left-most position of every header text, with its locale when annotated."""
    locale = F.col("locale") if "locale" in columns.columns else F.lit(None).cast("string")
    return (
        columns.groupBy("dataset_id", F.col("header").alias("source_column"))
        .agg(F.min(F.struct("col_idx", locale.alias("locale"))).alias("_p"))
        .select("dataset_id", "source_column", "_p.*")
    )


def bind(mappings: DataFrame, columns: DataFrame, fields: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """Mappings resolved to positions: one row per (dataset, field) with everything conversion needs.

    Inventory sized (datasets x fields). An inferred constant reads as a decimal-point literal (C9).
    """
    bound = mappings.join(header_positions(columns), ["dataset_id", "source_column"], "left").join(
        fields.select(
            F.col("name").alias("target_field"), "pos", "type", "unit", "allowed_values", "required", "min", "max",
            F.col("date_format").alias("declared_format"),
        ),
        "target_field",
    )
    if formats is None:
        bound = bound.withColumn("resolved_format", F.lit(None).cast("string"))
    else:
        bound = bound.join(
            formats.select("dataset_id", "target_field", F.col("date_format").alias("resolved_format")),
            ["dataset_id", "target_field"], "left",
        )
    constant = F.when(F.col("source_column").isNull(), F.col("inferred_value"))
    return bound.withColumn("constant", constant).withColumn(
        "locale", F.when(F.col("col_idx").isNull(), numbers.DECIMAL_POINT).otherwise(F.col("locale"))
    )


def raw_value(cells: Column, col_idx: Column, constant: Column) -> Column:
    """The mapped cell, or the constant where no column was mapped."""
    return F.when(col_idx.isNotNull(), F.try_element_at(cells, col_idx + 1)).otherwise(constant)


def parsed_field(field: Field, raw: Column, locale: Column, resolved: Column) -> Column:
    """What a raw text reads as under the declared type, which is known when the plan is built; integers still as doubles."""
    if field.type in ("number", "integer"):
        return numbers.parse_number(raw, locale)
    if field.type == "date":
        return dates.convert_date(raw, F.coalesce(resolved, F.lit(field.date_format).cast("string")))
    return raw


def finished_field(field: Field, raw: Column, parsed: Column, locale: Column) -> tuple[Column, Column]:
    """(typed value, flagged) of one declared field, given what its text reads as."""
    if field.type == "number":
        return parsed, numbers.number_flag(raw, locale, parsed)
    if field.type == "integer":
        narrowed = numbers.narrow_to_long(parsed)
        return narrowed, numbers.number_flag(raw, locale, parsed) | (parsed.isNotNull() & narrowed.isNull())
    if field.type == "date":
        return parsed, raw.isNotNull() & parsed.isNull()
    flagged = F.lit(False)
    if field.unit is not None:
        flagged = unit_mismatch(raw, F.lit(field.type).cast("string"), F.lit(field.unit))
    return raw, flagged


def convert_field(field: Field, raw: Column, locale: Column, resolved: Column) -> tuple[Column, Column]:
    """(typed value, flagged) of one declared field in one expression; over many rows, stage the two steps in projections."""
    return finished_field(field, raw, parsed_field(field, raw, locale, resolved), locale)


def assemble(
    rows: DataFrame,
    bound: DataFrame,
    field_set: FieldSet,
    source_sheet: DataFrame | None = None,
) -> DataFrame:
    """One typed record per source row.

    Columns: dataset_id, row_idx, the fields in declared order, `__raw` (original text of cells
    that did not convert), `__flags` (fields flagged in this row), and `__source_sheet` when
    `source_sheet` (dataset_id, origin_sheet) is given.
    """
    binding = F.struct("col_idx", "locale", "resolved_format", "constant")
    per_dataset = bound.groupBy("dataset_id").agg(*[
        F.max(F.when(F.col("target_field") == f.name, binding)).alias(f"_b{i}")
        for i, f in enumerate(field_set.fields)
    ])
    if source_sheet is not None:
        per_dataset = per_dataset.join(
            source_sheet.select("dataset_id", F.col("origin_sheet").alias(SOURCE_SHEET)), "dataset_id", "left"
        )
    joined = rows.join(per_dataset, "dataset_id")
    staged = joined.select(
        "dataset_id", "row_idx",
        *([SOURCE_SHEET] if source_sheet is not None else []),
        *[F.col(f"_b{i}") for i in range(len(field_set.fields))],
        *[
            raw_value(F.col("cells"), F.col(f"_b{i}.col_idx"), F.col(f"_b{i}.constant")).alias(f"_r{i}")
            for i in range(len(field_set.fields))
        ],
    )
    parsed = staged.withColumns({
        f"_v{i}": parsed_field(f, F.col(f"_r{i}"), F.col(f"_b{i}.locale"), F.col(f"_b{i}.resolved_format")) for i, f in enumerate(field_set.fields)
    })
    typed, flags, kept = [], [], []
    for i, field in enumerate(field_set.fields):
        raw = F.col(f"_r{i}")
        value, flagged = finished_field(field, raw, F.col(f"_v{i}"), F.col(f"_b{i}.locale"))
        typed.append(value.cast(SPARK_TYPES[field.type]).alias(field.name))
        flags.append(F.when(flagged, F.lit(field.name)))
        if SPARK_TYPES[field.type] != "string":
            kept.append(F.when(raw.isNotNull() & value.isNull(), F.struct(F.lit(field.name).alias("key"), raw.alias("value"))))
    entries = F.array_compact(F.array(*kept)) if kept else F.array().cast("array<struct<key:string,value:string>>")
    return parsed.select(
        "dataset_id", "row_idx", *typed,
        F.map_from_entries(entries).alias("__raw"),
        F.array_compact(F.array(*flags)).alias("__flags"),
        *([SOURCE_SHEET] if source_sheet is not None else []),
    )


def assemble_wide(df: DataFrame, positions: dict[str, Column], locales: dict[str, str], field_set: FieldSet, formats: dict[str, str] | None = None) -> DataFrame:
    """C10 for one wide table with a settled mapping: projections alone, no join and no shuffle.

    Staged, so that a raw text is made once a row and read once, however often its value and flag refer to it.
    """
    fields = list(enumerate(field_set.fields))
    locale = {f.name: F.lit(locales.get(f.name)).cast("string") for f in field_set.fields}
    raws = df.select(*[(positions[f.name].cast("string") if f.name in positions else F.lit(None).cast("string")).alias(f"_r{i}") for i, f in fields])
    parsed = raws.withColumns({
        f"_v{i}": parsed_field(f, F.col(f"_r{i}"), locale[f.name], F.lit((formats or {}).get(f.name)).cast("string")) for i, f in fields
    })
    typed, flags = [], []
    for i, field in fields:
        value, flagged = finished_field(field, F.col(f"_r{i}"), F.col(f"_v{i}"), locale[field.name])
        typed.append(value.cast(SPARK_TYPES[field.type]).alias(field.name))
        flags.append(F.when(flagged, F.lit(field.name)))
    return parsed.select(*typed, F.array_compact(F.array(*flags)).alias("__flags"))


def flagged_fields(tidy: DataFrame) -> DataFrame:
    """C11: dataset_id, target_field, n_flagged. A hot dataset shrinks to fields x partitions rows first."""
    return (
        tidy.select("dataset_id", F.explode("__flags").alias("target_field"))
        .groupBy("dataset_id", "target_field")
        .agg(F.count("*").alias("n_flagged"))
    )


def resolve_date_formats(
    rows: DataFrame,
    columns: DataFrame,
    mappings: DataFrame,
    fields: DataFrame,
    answers: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(formats, conflicts, contradictions) for every mapped column feeding a date field.

    `answers` is (dataset_id, target_field, order). Only the mapped date columns are read; the
    verdicts, one row per date column, are settled so that the three results share one scan.
    """
    spots = bind(mappings.filter(F.col("source_column").isNotNull()), columns, fields).filter(F.col("type") == "date")
    wanted = spots.filter(F.col("col_idx").isNotNull())
    verdicts = classify_date_order(rows, wanted)
    key = ["dataset_id", "col_idx"]
    seen = settle(wanted.join(verdicts, key, "left"))
    # Evidence already says whether all values fit the column's own two formats; any other
    # declared format of an ambiguous column is tried on its values.
    own = F.col("declared_format").isin(F.col("day_first_format"), F.col("month_first_format"))
    other = seen.filter((F.col("order") == dates.AMBIGUOUS) & F.col("declared_format").isNotNull() & ~own)
    tried = parses_all(rows, other.select(*key, F.col("declared_format").alias("date_format")).distinct())
    fits = F.when(F.col("declared_format") == F.col("day_first_format"), F.col("day_first_fits")).when(
        F.col("declared_format") == F.col("month_first_format"), F.col("month_first_fits")
    )
    judged = (
        seen.join(tried.withColumnRenamed("date_format", "declared_format"), [*key, "declared_format"], "left")
        .withColumn("parses_all", F.coalesce(fits, F.col("parses_all")))
    )
    if answers is None:
        judged = judged.withColumn("answer", F.lit(None).cast("string"))
    else:
        judged = judged.join(
            answers.select("dataset_id", "target_field", F.col("order").alias("answer")),
            ["dataset_id", "target_field"], "left",
        )
    order = F.coalesce(F.col("order"), F.lit(dates.NON_DATE))
    ambiguous = order == dates.AMBIGUOUS
    trusted = ambiguous & F.coalesce(F.col("parses_all"), F.lit(False))
    answered = ambiguous & ~trusted & F.col("answer").isNotNull()
    open_question = ambiguous & ~trusted & F.col("answer").isNull()
    proven = order.isin(dates.DAY_FIRST, dates.MONTH_FIRST, dates.ISO)
    implied = dates.implied_order(F.col("declared_format"))
    disagrees = proven & F.coalesce(implied != order, F.lit(False))
    chosen = (
        F.when(order == dates.EXCEL_SERIAL, F.lit(dates.EXCEL_SERIAL))
        .when(trusted, F.col("declared_format"))
        .when(answered, dates.format_for_order(F.col("day_first_format"), F.col("month_first_format"), F.col("answer")))
        .when(proven & ~disagrees, F.col("date_format"))
    )
    contradiction = disagrees | (open_question & F.col("declared_format").isNotNull())
    decided = settle(judged.select(
        "dataset_id", "target_field", "source_column", "col_idx", "declared_format", "day_first_format",
        "month_first_format", "n_nonblank", chosen.alias("date_format"),
        open_question.alias("_open"), contradiction.alias("_contradiction"),
    ))
    shown = example_values(rows, decided.filter(F.col("_open") | F.col("_contradiction")))
    formats = decided.filter(F.col("date_format").isNotNull()).select("dataset_id", "target_field", "date_format")
    conflicts = (
        decided.filter("_open")
        .join(shown, key, "left")
        .select(
            "dataset_id", "target_field", "source_column", "day_first_format", "month_first_format",
            "example_values", F.col("n_nonblank").alias("ambiguous_row_count"),
        )
    )
    contradictions = (
        decided.filter("_contradiction")
        .join(shown, key, "left")
        .select(
            "dataset_id", "target_field", "declared_format",
            F.coalesce(F.try_element_at(F.col("example_values"), F.lit(1)), F.lit("")).alias("example_value"),
        )
    )
    return formats, conflicts, contradictions


def require_date_answers(conflicts: DataFrame, answered_datasets: DataFrame) -> DataFrame:
    """Error rows for datasets that came with answers yet leave a date column undecided."""
    return conflicts.join(answered_datasets.select("dataset_id").distinct(), "dataset_id", "left_semi").select(
        "dataset_id",
        F.concat(F.lit("date order of '"), F.col("target_field"), F.lit("' is still undecided")).alias("error"),
    )
