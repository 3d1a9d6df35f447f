"""Bring any DataFrame or extracted workbook cells into the engine's frames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_header
from ..model import Tables, dataset_id


def from_dataframe(
    df: DataFrame,
    source_file: str,
    row_idx: Column,
    columns: Mapping[str, Column] | None = None,
    sheet: str | None = None,
) -> Tables:
    """A table as one dataset. `row_idx` must give a unique, increasing bigint per row.

    Values become strings, missing values blanks. Narrow: no shuffle, columns pruned to those named.
    """
    spark = df.sparkSession
    picked = dict(columns) if columns is not None else {name: F.col(name) for name in df.columns}
    ident = dataset_id(F.lit(source_file), F.lit(sheet), F.lit(0))
    datasets = spark.range(1).select(
        ident.alias("dataset_id"),
        F.lit(source_file).alias("source_file"),
        F.lit(sheet or source_file).alias("sheet"),
        F.lit(0).alias("table_idx"),
        F.lit(sheet or source_file).alias("origin_sheet"),
        F.lit(None).cast("string").alias("label"),
    )
    header_frame = spark.createDataFrame(list(enumerate(picked)), "col_idx int, raw string").select(
        ident.alias("dataset_id"), "col_idx", clean_header(F.col("raw")).alias("header")
    )
    cells = F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in picked.values()])
    rows = df.select(ident.alias("dataset_id"), row_idx.cast("bigint").alias("row_idx"), cells.alias("cells"))
    return Tables(datasets, header_frame, rows)


def union_tables(*parts: Tables) -> Tables:
    """Several corpora as one."""
    merged = parts[0]
    for part in parts[1:]:
        merged = Tables(*(a.unionByName(b) for a, b in zip(merged, part)))
    return merged


def grid_from_cells(cells: DataFrame) -> DataFrame:
    """Extracted workbook cells (file_id, sheet, row_idx, col_idx, v, t) as grid rows.

    Grouped by single row; rows that hold no cell at all come back as empty arrays.
    """
    keys = ["file_id", "sheet", "row_idx"]
    wide = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("col_idx", F.struct("v", "t").alias("cell")))).alias("_e"))
    empty = F.struct(F.lit(None).cast("string").alias("v"), F.lit("blank").alias("t"))
    return wide.select(*keys, filled_row("_e", empty).alias("cells"))


def filled_row(entries: str, empty: Column) -> Column:
    """A row's sorted (col_idx, cell) entries as its cells, gaps filled: each entry brings the gap before it, so a row costs its width."""
    before = lambda i: F.when(i > 0, F.get(F.col(entries), i - 1)["col_idx"]).otherwise(-1)
    return F.flatten(F.transform(F.col(entries), lambda e, i: F.concat(F.array_repeat(empty, e["col_idx"] - before(i) - 1), F.array(e["cell"]))))


def cells_from_rows(rows: DataFrame) -> DataFrame:
    """Long view of data rows: dataset_id, row_idx, col_idx, v. Narrow.

    The outer form is used because the plain one adds a filter that works the cells out twice.
    """
    return rows.select("dataset_id", "row_idx", F.posexplode_outer("cells").alias("col_idx", "v")).filter(F.col("col_idx").isNotNull())


def stringify_row(cells: Column) -> Column:
    """Typed cells as strings, blanks as empty strings."""
    return F.transform(cells, lambda c: F.coalesce(c["v"], F.lit("")))


def pad_row(cells: Column, width: Column) -> Column:
    """Exactly `width` strings per row; short rows padded, long ones cut."""
    padding = F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0)))
    return F.slice(F.concat(cells, padding), F.lit(1), width)
