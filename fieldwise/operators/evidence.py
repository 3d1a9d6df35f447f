"""Column evidence: decimal locale, date order, counts, redaction.

Every operator here is one scan with mergeable, fixed-width aggregates keyed by
(dataset, column): the shuffle carries columns x partitions rows, never cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..functions.text import is_blank, strip
from ..model import EVIDENCE_GRID_COLUMNS, EVIDENCE_GRID_ROWS
from ..sources.frames import cells_from_rows

_COLUMN_KEY = ["dataset_id", "col_idx"]


def classify_locale(rows: DataFrame) -> DataFrame:
    """dataset_id, col_idx, locale."""
    parts = numbers.locale_aggregates(F.col("v"))
    evidence = cells_from_rows(rows).groupBy(*_COLUMN_KEY).agg(*[a.alias(n) for n, a in parts.items()])
    return evidence.select(*_COLUMN_KEY, numbers.locale_verdict(*[F.col(n) for n in parts]).alias("locale"))


def annotate_locales(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """Every column with its locale; columns without values are non-numeric."""
    return columns.join(classify_locale(rows), _COLUMN_KEY, "left").withColumn(
        "locale", F.coalesce("locale", F.lit(numbers.NON_NUMERIC))
    )


def resolve_locales(annotated: DataFrame, hints: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, questions, errors) after joining answers (dataset_id, decimal_separator).

    An answer settles only ambiguous columns; an unusable answer is an error row and settles nothing.
    """
    if hints is None:
        joined = annotated.withColumn("decimal_separator", F.lit(None).cast("string"))
    else:
        joined = annotated.join(hints.select("dataset_id", "decimal_separator"), "dataset_id", "left")
    answer = F.when(F.col("decimal_separator") == ",", numbers.DECIMAL_COMMA).when(
        F.col("decimal_separator") == ".", numbers.DECIMAL_POINT
    )
    resolved = joined.withColumn(
        "locale", F.when(F.col("locale") == numbers.AMBIGUOUS, F.coalesce(answer, F.col("locale"))).otherwise(F.col("locale"))
    )
    questions = (
        resolved.filter(F.col("locale") == numbers.AMBIGUOUS)
        .groupBy("dataset_id")
        .agg(F.array_sort(F.collect_list(F.struct("col_idx", "header"))).alias("_columns"))
        .select(
            "dataset_id",
            F.lit("decimal_locale").alias("kind"),
            F.transform("_columns", lambda c: c["header"]).alias("columns"),
        )
    )
    errors = (
        joined.filter(F.col("decimal_separator").isNotNull() & ~F.col("decimal_separator").isin(",", "."))
        .select("dataset_id", F.concat(F.lit("Cannot apply the hint: '"), F.col("decimal_separator"), F.lit("' is no decimal separator")).alias("error"))
        .distinct()
    )
    return resolved.drop("decimal_separator"), questions, errors


def wanted_cells(rows: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """Cells of the wanted (dataset_id, col_idx) columns only; all cells when none are named."""
    if wanted is None:
        return cells_from_rows(rows)
    lists = wanted.groupBy("dataset_id").agg(F.array_sort(F.collect_set("col_idx")).alias("_wanted"))
    return (
        rows.join(lists, "dataset_id")
        .select("dataset_id", "row_idx", "cells", F.explode("_wanted").alias("col_idx"))
        .select("dataset_id", "row_idx", "col_idx", F.try_element_at(F.col("cells"), F.col("col_idx") + 1).alias("v"))
    )


def date_evidence(rows: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Order evidence as flat counters; one pass, hash-aggregated."""
    cells = wanted_cells(rows, wanted)
    staged = dates.with_date_parts(cells, {"_parts": F.col("v")})
    aggregates = dates.order_aggregates(F.col("_parts"), F.col("row_idx"))
    return staged.groupBy(*_COLUMN_KEY).agg(
        *[a.alias(n) for n, a in aggregates.items()], F.count_if(F.col("_parts.filled")).alias("n_nonblank")
    )


class _Flat(dict):
    """Evidence columns addressed by name."""

    def __missing__(self, key: str) -> Column:
        return F.col(key)


def classify_date_order(rows: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """P5: dataset_id, col_idx, order, date_format, day_first_format, month_first_format, n_nonblank,
    and whether every non-blank value fits the one or the other candidate format."""
    return date_evidence(rows, wanted).select(
        *_COLUMN_KEY, "n_nonblank", (F.col("n_dm") == F.col("n_nonblank")).alias("_only"), dates.order_verdict(_Flat()).alias("_v")
    ).select(
        *_COLUMN_KEY, "_v.order", "_v.date_format", "_v.day_first_format", "_v.month_first_format", "n_nonblank",
        (F.col("_only") & F.col("_v.day_first_fits")).alias("day_first_fits"), (F.col("_only") & F.col("_v.month_first_fits")).alias("month_first_fits"),
    )


def example_values(rows: DataFrame, wanted: DataFrame, limit: int = 3) -> DataFrame:
    """The first non-blank values of the wanted (dataset_id, col_idx) columns, in row order.

    The rank filter becomes a partial group limit before the shuffle, so at most
    `limit` values per column and task move.
    """
    value = F.try_element_at(F.col("cells"), F.col("col_idx") + 1)
    picked = (
        rows.join(wanted.select(*_COLUMN_KEY).distinct(), "dataset_id")
        .select(*_COLUMN_KEY, "row_idx", strip(value).alias("v"))
        .filter(F.col("v") != "")
    )
    rank = F.row_number().over(Window.partitionBy(*_COLUMN_KEY).orderBy("row_idx"))
    return (
        picked.withColumn("_rank", rank)
        .filter(F.col("_rank") <= limit)
        .groupBy(*_COLUMN_KEY)
        .agg(F.array_sort(F.collect_list(F.struct("row_idx", "v"))).alias("_e"))
        .select(*_COLUMN_KEY, F.transform("_e", lambda e: e["v"]).alias("example_values"))
    )


def parses_all(rows: DataFrame, formats: DataFrame) -> DataFrame:
    """Whether every non-blank value of a column parses under its given format.

    `formats` is (dataset_id, col_idx, date_format): a declaration inventory, joined to rows by dataset.
    """
    value = F.try_element_at(F.col("cells"), F.col("col_idx") + 1)
    parsed = dates.parse_date(value, F.col("date_format")).isNotNull()
    return (
        rows.join(formats, "dataset_id")
        .groupBy("dataset_id", "col_idx", "date_format")
        .agg(F.coalesce(F.bool_and(F.when(~is_blank(value), parsed)), F.lit(True)).alias("parses_all"))
    )


def nonblank_counts(rows: DataFrame) -> DataFrame:
    """Non-blank cells per column."""
    return cells_from_rows(rows).groupBy(*_COLUMN_KEY).agg(F.count_if(~is_blank(F.col("v"))).alias("n_nonblank"))


def bucket(value: Column, kind: Column) -> Column:
    """A cell as its type or length bucket, never its content."""
    length = F.length(strip(F.regexp_replace(value, r"[\s\p{Z}]+", " ")))
    return (
        F.when((kind == "blank") | is_blank(value), "blank")
        .when(kind.isin("num", "bool"), "num")
        .when(kind == "date", "date")
        .when(length <= 8, "str:short")
        .when(length <= 24, "str:med")
        .otherwise("str:long")
    )


def redact_to_types(grid: DataFrame, max_rows: int = EVIDENCE_GRID_ROWS, max_cols: int = EVIDENCE_GRID_COLUMNS) -> DataFrame:
    """The leading window of a grid as buckets, with the grid's true dimensions."""
    dims = grid.groupBy("file_id", "sheet").agg(
        (F.max("row_idx") + 1).alias("n_rows"), F.max(F.size("cells")).alias("n_cols")
    )
    view = grid.filter(F.col("row_idx") < max_rows).select(
        "file_id", "sheet", "row_idx",
        F.transform(F.slice("cells", 1, max_cols), lambda c: bucket(c["v"], c["t"])).alias("buckets"),
    )
    return view.join(dims, ["file_id", "sheet"])


def headers_only(annotated: DataFrame) -> DataFrame:
    """Headers and locale evidence, no value column; the rows frame is never read."""
    return annotated.select("dataset_id", "col_idx", "header", "locale")


# ---- wide form: one very large table, no explode ---------------------------------------------


def wide_locales(df: DataFrame, columns: list[str]) -> DataFrame:
    """P1 for one wide table: a single aggregate, one row out per column."""
    evidence = df.agg(*[
        F.struct(*[a.alias(n) for n, a in numbers.locale_aggregates(F.col(f"`{c}`").cast("string")).items()]).alias(f"c{i}")
        for i, c in enumerate(columns)
    ])
    verdicts = F.array(*[
        F.struct(
            F.lit(i).alias("col_idx"), F.lit(c).alias("header"),
            numbers.locale_verdict(*[F.col(f"c{i}.{n}") for n in ("any_comma", "any_comma_not_three", "any_dot", "any_integer")]).alias("locale"),
        )
        for i, c in enumerate(columns)
    ])
    return evidence.select(F.inline(verdicts))


def wide_date_orders(df: DataFrame, columns: list[str], row_idx: Column) -> DataFrame:
    """P5 for one wide table: a single aggregate, one row out per column."""
    texts = df.select(row_idx.cast("bigint").alias("_row"), *[F.col(f"`{c}`").cast("string").alias(f"v{i}") for i, c in enumerate(columns)])
    staged = dates.with_date_parts(texts, {f"p{i}": F.col(f"v{i}") for i in range(len(columns))})
    evidence = staged.agg(*[
        F.struct(*[a.alias(n) for n, a in dates.order_aggregates(F.col(f"p{i}"), F.col("_row")).items()]).alias(f"c{i}")
        for i in range(len(columns))
    ])
    verdicts = F.array(*[
        F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("header"), dates.order_verdict(F.col(f"c{i}")).alias("verdict"))
        for i, c in enumerate(columns)
    ])
    return evidence.select(F.inline(verdicts)).select(
        "col_idx", "header", "verdict.order", "verdict.date_format", "verdict.day_first_format", "verdict.month_first_format"
    )
