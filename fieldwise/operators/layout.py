"""Layout verdicts: closure, fences, slices, un-pivot, decisions and questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..model import EVIDENCE_LEAD_IN, EVIDENCE_ROWS, LAYOUT_CONFIRMATION_BAR, Tables, dataset_id
from ..session import settle
from ..sources.frames import filled_row, pad_row, stringify_row
from .common import running_sum
from .header import SHEET_KEY, blank_cell, disambiguate_labels, header_texts

LAYOUT_KINDS = ("row_per_record", "key_value", "wide_matrix", "multiple_tables", "not_a_table", "unknown")


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, low: str, high: str) -> DataFrame:
    """Points inside ranges of the same key, as an equi-join.

    A range of length about 2^k is filed under the one or two blocks of size 2^k it touches, and
    a point looks only into its own block at each size the key really uses. Thousands of short
    fences on one sheet therefore never meet every row of it.
    """
    span = F.greatest(F.col(high) - F.col(low) + 1, F.lit(1))
    sized = ranges.filter(F.col(low) <= F.col(high)).withColumn("_level", F.floor(F.log2(span)).cast("int"))
    filed = sized.withColumn(
        "_block", F.explode(F.sequence(F.expr(f"`{low}` >> _level"), F.expr(f"`{high}` >> _level")))
    )
    levels = sized.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    placed = (
        points.join(levels, keys)
        .withColumn("_level", F.explode("_levels"))
        .drop("_levels")
        .withColumn("_block", F.expr(f"`{point}` >> _level"))
    )
    return (
        placed.join(filed, [*keys, "_level", "_block"])
        .filter(F.col(point).between(F.col(low), F.col(high)))
        .drop("_level", "_block")
    )


def grid_sizes(grid: DataFrame) -> DataFrame:
    return grid.groupBy(*SHEET_KEY).agg((F.max("row_idx") + 1).alias("n_rows"), F.max(F.size("cells")).alias("n_cols"))


def layout_from_hints(hints: DataFrame) -> DataFrame:
    """L1: an explicit layout wins; an explicit header row means row-per-record at certainty; else none.

    hints: file_id, sheet, structural_hint (the model's HINT struct).
    """
    hint = F.col("structural_hint")
    from_header = F.when(
        hint["header_row"].isNotNull(),
        F.struct(
            F.lit("row_per_record").alias("kind"), F.lit(1.0).alias("confidence"), hint["header_row"].alias("header_row_index"),
            F.lit(None).cast("bigint").alias("first_data_row"), F.lit(None).cast("bigint").alias("last_data_row"),
            F.array().cast("array<struct<label_column:int,value_columns:array<int>,first_row:bigint,last_row:bigint>>").alias("key_value_blocks"),
            F.lit(False).alias("one_record_per_value_column"),
            F.array().cast("array<struct<header_row_index:bigint,first_data_row:bigint,last_data_row:bigint,title_row_index:bigint>>").alias("tables"),
        ),
    )
    chosen = hints.select(*SHEET_KEY, F.coalesce(hint["layout"], from_header).alias("_l")).filter(F.col("_l").isNotNull())
    return chosen.select(
        *SHEET_KEY, "_l.kind", "_l.confidence", F.lit("answered by a person").alias("reasoning"), "_l.header_row_index",
        "_l.first_data_row", "_l.last_data_row", "_l.key_value_blocks", "_l.one_record_per_value_column", "_l.tables",
    )


def _outside(index: Column, size: Column) -> Column:
    return index.isNotNull() & ~index.between(0, size - 1)


def rejected_index(n_rows: Column, n_cols: Column) -> Column:
    """True where any index of a verdict row does not fit the grid, or a range is inverted."""
    rows = [F.col(c) for c in ("header_row_index", "first_data_row", "last_data_row")]
    bad = _outside(rows[0], n_rows) | _outside(rows[1], n_rows) | _outside(rows[2], n_rows)
    inverted = F.coalesce(rows[1] > rows[2], F.lit(False))
    tables = F.exists(
        F.coalesce("tables", F.array()),
        lambda t: _outside(F.coalesce(t["header_row_index"], F.lit(-1)), n_rows)
        | _outside(F.coalesce(t["first_data_row"], F.lit(-1)), n_rows)
        | _outside(F.coalesce(t["last_data_row"], F.lit(-1)), n_rows)
        | _outside(t["title_row_index"], n_rows)
        | F.coalesce(t["first_data_row"] > t["last_data_row"], F.lit(False)),
    )
    blocks = F.exists(
        F.coalesce("key_value_blocks", F.array()),
        lambda b: _outside(F.coalesce(b["label_column"], F.lit(-1)), n_cols)
        | F.exists(b["value_columns"], lambda c: _outside(c, n_cols))
        | _outside(F.coalesce(b["first_row"], F.lit(-1)), n_rows)
        | _outside(F.coalesce(b["last_row"], F.lit(-1)), n_rows)
        | F.coalesce(b["first_row"] > b["last_row"], F.lit(False)),
    )
    return bad | inverted | tables | blocks


def close_layouts(verdicts: DataFrame, grid: DataFrame) -> DataFrame:
    """L2: exactly one verdict per real sheet.

    verdicts: the layout columns plus `position`. Unknown sheets drop, the first verdict per sheet
    stays, an index outside the grid or a missing verdict means unknown at confidence zero.
    """
    first = Window.partitionBy(*SHEET_KEY).orderBy("position")
    kept = verdicts.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1).drop("_n", "position").withColumn("_given", F.lit(True))
    joined = grid_sizes(grid).join(kept, SHEET_KEY, "left")
    good = F.coalesce(F.col("_given"), F.lit(False)) & ~rejected_index(F.col("n_rows"), F.col("n_cols"))
    reason = F.when(good, F.col("reasoning")).when(F.col("_given"), "the verdict names rows or columns this sheet does not have").otherwise("no verdict was given for this sheet")
    blocks = F.array().cast("array<struct<label_column:int,value_columns:array<int>,first_row:bigint,last_row:bigint>>")
    tables = F.array().cast("array<struct<header_row_index:bigint,first_data_row:bigint,last_data_row:bigint,title_row_index:bigint>>")
    return joined.select(
        *SHEET_KEY,
        F.when(good & F.col("kind").isin(*LAYOUT_KINDS), F.col("kind")).otherwise("unknown").alias("kind"),
        F.when(good, F.greatest(F.least(F.col("confidence"), F.lit(1.0)), F.lit(0.0))).otherwise(0.0).alias("confidence"),
        reason.alias("reasoning"),
        *[F.when(good, F.col(c)).alias(c) for c in ("header_row_index", "first_data_row", "last_data_row")],
        F.when(good, F.coalesce("key_value_blocks", blocks)).otherwise(blocks).alias("key_value_blocks"),
        F.when(good, F.coalesce("one_record_per_value_column", F.lit(False))).otherwise(False).alias("one_record_per_value_column"),
        F.when(good, F.coalesce("tables", tables)).otherwise(tables).alias("tables"),
    )


def judge_layouts(grid: DataFrame, known: DataFrame | None, judge: Callable[[DataFrame], DataFrame] | None, redact: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Verdicts for sheets that lack one, from a callable that sees only redacted buckets."""
    open_grid = grid if known is None else grid.join(known.select(*SHEET_KEY), SHEET_KEY, "left_anti")
    if judge is None:
        answers = known if known is not None else None
    else:
        given = judge(redact(open_grid))
        answers = given if known is None else given.unionByName(known.withColumn("position", F.lit(0)))
    if answers is None:
        return grid_sizes(grid).select(*SHEET_KEY, F.lit("unknown").alias("kind"), F.lit(0.0).alias("confidence"))
    if "position" not in answers.columns:
        answers = answers.withColumn("position", F.lit(0))
    return close_layouts(answers, grid)


def fences(layouts: DataFrame) -> DataFrame:
    """The tables of every sheet: file_id, sheet, table_idx, header_row, first_row, last_row, title_row."""
    return layouts.select(*SHEET_KEY, F.posexplode("tables").alias("table_idx", "t")).select(
        *SHEET_KEY, "table_idx", F.col("t.header_row_index").alias("header_row"), F.col("t.first_data_row").alias("first_row"),
        F.col("t.last_data_row").alias("last_row"), F.col("t.title_row_index").alias("title_row"),
    )


def _fence_id() -> Column:
    return dataset_id(F.col("file_id"), F.col("sheet"), F.col("table_idx"))


def fence_tables(grid: DataFrame, fenced: DataFrame) -> tuple[Tables, DataFrame]:
    """L3: (tables, errors). Each fence becomes its own dataset; a fence outside its grid is an error row."""
    sized = fenced.join(grid_sizes(grid), SHEET_KEY, "left")
    bad = (
        F.col("n_rows").isNull() | (F.col("first_row") > F.col("last_row"))
        | _outside(F.col("header_row"), F.col("n_rows")) | _outside(F.col("first_row"), F.col("n_rows")) | _outside(F.col("last_row"), F.col("n_rows"))
    )
    errors = sized.filter(bad).select(*SHEET_KEY, "table_idx", F.lit("the table's rows do not fit the sheet").alias("error"))
    good = sized.filter(~bad).drop("n_rows", "n_cols")
    heads = grid.withColumnRenamed("row_idx", "header_row").join(good, [*SHEET_KEY, "header_row"])
    columns = heads.select(_fence_id().alias("dataset_id"), F.posexplode(header_texts(F.col("cells"))).alias("col_idx", "header"))
    widths = heads.select(*SHEET_KEY, "table_idx", F.size("cells").alias("_width"))
    bounds = good.join(widths, [*SHEET_KEY, "table_idx"]).select(*SHEET_KEY, "table_idx", "first_row", "last_row", "_width")
    inside = range_join(grid, bounds, SHEET_KEY, "row_idx", "first_row", "last_row")
    rows = inside.select(
        _fence_id().alias("dataset_id"), (F.col("row_idx") - F.col("first_row")).alias("row_idx"),
        pad_row(stringify_row(F.col("cells")), F.col("_width")).alias("cells"),
    )
    datasets = good.select(
        _fence_id().alias("dataset_id"), F.col("file_id").alias("source_file"), "sheet", "table_idx",
        F.col("sheet").alias("origin_sheet"), _row_label().alias("label"),
    )
    return Tables(datasets, columns, rows), errors


def _row_label() -> Column:
    return F.concat(F.lit("rows "), (F.col("header_row") + 1).cast("string"), F.lit("-"), (F.col("last_row") + 1).cast("string"))


def table_titles(grid: DataFrame, fenced: DataFrame) -> DataFrame:
    """L4: file_id, sheet, table_idx, title (first filled cell of the named row), label."""
    rows = grid.select(*SHEET_KEY, F.col("row_idx").alias("title_row"), "cells")
    first = F.try_element_at(F.filter("cells", lambda c: ~blank_cell(c)), F.lit(1))["v"]
    return fenced.join(rows, [*SHEET_KEY, "title_row"], "left").select(
        *SHEET_KEY, "table_idx", strip(first).alias("title"), _row_label().alias("label")
    )


def slice_at_header(grid: DataFrame, headers: DataFrame) -> Tables:
    """The header row names the columns, the rows below become data, padded to its width.

    headers: file_id, sheet, header_row, and first_row and last_row where a verdict bounds the data.
    """
    if "first_row" not in headers.columns:
        headers = headers.withColumns({"first_row": F.col("header_row") + 1, "last_row": F.lit(None).cast("bigint")})
    ident = dataset_id(F.col("file_id"), F.col("sheet"), F.lit(0))
    named = grid.withColumnRenamed("row_idx", "header_row").join(headers.select(*SHEET_KEY, "header_row", "first_row", "last_row"), [*SHEET_KEY, "header_row"])
    columns = named.select(ident.alias("dataset_id"), F.posexplode(header_texts(F.col("cells"))).alias("col_idx", "header"))
    cut = named.select(*SHEET_KEY, "first_row", "last_row", F.size("cells").alias("_width"))
    inside = (F.col("row_idx") >= F.col("first_row")) & F.coalesce(F.col("row_idx") <= F.col("last_row"), F.lit(True))
    rows = grid.join(cut, SHEET_KEY).filter(inside).select(
        ident.alias("dataset_id"), (F.col("row_idx") - F.col("first_row")).alias("row_idx"),
        pad_row(stringify_row(F.col("cells")), F.col("_width")).alias("cells"),
    )
    per_file = Window.partitionBy("file_id")
    datasets = cut.withColumn("_sheets", F.count("*").over(per_file)).select(
        ident.alias("dataset_id"), F.col("file_id").alias("source_file"), "sheet", F.lit(0).alias("table_idx"),
        F.col("sheet").alias("origin_sheet"), F.when(F.col("_sheets") > 1, F.col("sheet")).alias("label"),
    )
    return Tables(datasets, columns, rows)


def evidence_window(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """At most eight rows from two above the header (the top without one), as strings."""
    start = F.greatest(F.coalesce(F.col("header_row"), F.lit(0)) - EVIDENCE_LEAD_IN, F.lit(0))
    asked = headers.select(*SHEET_KEY, start.alias("_start"))
    window = grid.join(asked, SHEET_KEY).filter(F.col("row_idx").between(F.col("_start"), F.col("_start") + EVIDENCE_ROWS - 1))
    return window.groupBy(*SHEET_KEY, F.col("_start").alias("evidence_first_row")).agg(
        F.array_sort(F.collect_list(F.struct("row_idx", stringify_row(F.col("cells")).alias("cells")))).alias("_r")
    ).select(*SHEET_KEY, "evidence_first_row", F.transform("_r", lambda r: r["cells"]).alias("evidence_rows"))


def sample_rows(rows: DataFrame, n: int, first_row: Column | None = None) -> DataFrame:
    """The first n rows of each dataset or fence by position; a plain filter."""
    start = F.lit(0) if first_row is None else first_row
    return rows.filter((F.col("row_idx") - start).between(0, n - 1))


def _blocks(layouts: DataFrame) -> DataFrame:
    return layouts.select(
        *SHEET_KEY, "one_record_per_value_column", F.posexplode("key_value_blocks").alias("block_idx", "b")
    ).select(
        *SHEET_KEY, F.coalesce("one_record_per_value_column", F.lit(False)).alias("melt"), "block_idx",
        F.col("b.label_column").alias("label_column"), F.col("b.value_columns").alias("value_columns"),
        F.col("b.first_row").alias("first_row"), F.col("b.last_row").alias("last_row"),
    )


def unreadable_blocks(grid: DataFrame, layouts: DataFrame) -> DataFrame:
    """Key-value sheets without blocks, or with an index outside the grid; nothing is read from them."""
    judged = layouts.filter(F.col("kind") == "key_value").join(grid_sizes(grid), SHEET_KEY, "left")
    bad = F.col("n_rows").isNull() | (F.coalesce(F.size("key_value_blocks"), F.lit(0)) == 0) | rejected_index(F.col("n_rows"), F.col("n_cols"))
    return judged.filter(bad).select(*SHEET_KEY, F.lit("layout").alias("kind"), F.lit("the blocks do not fit the sheet").alias("reason"))


def unpivot_key_value(grid: DataFrame, layouts: DataFrame) -> Tables:
    """Labels become columns, values become one record, or one per value column when melting.

    Rows blank in label and values are skipped; a blank label over a value stays. A sheet's labels
    are its columns, so what is settled here is a header inventory with its few values.
    """
    readable = layouts.filter(F.col("kind") == "key_value").join(unreadable_blocks(grid, layouts), SHEET_KEY, "left_anti")
    inside = range_join(grid, _blocks(readable), SHEET_KEY, "row_idx", "first_row", "last_row")
    cell = lambda i: F.try_element_at(F.col("cells"), i + 1)
    text = lambda c: F.coalesce(c["v"], F.lit(""))
    picked = inside.select(
        dataset_id(F.col("file_id"), F.col("sheet"), F.lit(0)).alias("dataset_id"), "file_id", "sheet", "melt", "block_idx", "row_idx",
        F.coalesce(strip(cell(F.col("label_column"))["v"]), F.lit("")).alias("label"),
        F.transform("value_columns", lambda c: text(cell(c))).alias("values"),
    ).filter((F.col("label") != "") | F.exists("values", lambda v: strip(v) != ""))
    # Ranks without a window over a sheet: places inside a block by running sums, on top of the totals of the sheet's few blocks.
    values = F.size("values")
    labels = F.when(values == 0, 0).when(F.col("melt"), 1).otherwise(values)
    inside = running_sum(picked, ["dataset_id", "block_idx"], "row_idx", labels, "_before")
    blocks = picked.groupBy("dataset_id", "block_idx").agg(F.sum(labels).alias("_labels"), F.max(values).alias("_records"))
    earlier = Window.partitionBy("dataset_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("dataset_id", "block_idx", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_labels", "_records")))
    entries = inside.join(starts, ["dataset_id", "block_idx"]).select("*", F.posexplode("values").alias("value_idx", "v"))
    spot = F.col("_labels") + F.col("_before") + F.when(F.col("melt"), 0).otherwise(F.col("value_idx"))
    record = F.when(F.col("melt"), F.col("_records") + F.col("value_idx")).otherwise(0)
    placed = settle(entries.select("dataset_id", "file_id", "sheet", "label", "v", spot.cast("int").alias("col_idx"), record.alias("record")))
    columns = disambiguate_labels(placed.select("dataset_id", "col_idx", F.col("label").alias("header")).distinct())
    widths = columns.groupBy("dataset_id").agg((F.max("col_idx") + 1).alias("_width"))
    rows = (
        placed.groupBy("dataset_id", "record").agg(F.array_sort(F.collect_list(F.struct("col_idx", F.col("v").alias("cell")))).alias("_e"))
        .join(widths, "dataset_id")
        .select("dataset_id", F.col("record").cast("bigint").alias("row_idx"), pad_row(filled_row("_e", F.lit("")), F.col("_width")).alias("cells"))
    )
    datasets = placed.select(
        "dataset_id", F.col("file_id").alias("source_file"), "sheet", F.lit(0).alias("table_idx"),
        F.col("sheet").alias("origin_sheet"), F.lit(None).cast("string").alias("label"),
    ).distinct()
    return Tables(datasets, columns, rows)


def decide_layout(layouts: DataFrame, confirmed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(readable, questions). Only a confident row-per-record or a confirmed verdict proceeds."""
    if confirmed is None:
        marked = layouts.withColumn("_confirmed", F.lit(False))
    else:
        marked = layouts.join(confirmed.select(*SHEET_KEY).distinct().withColumn("_confirmed", F.lit(True)), SHEET_KEY, "left")
    sure = (F.col("kind") == "row_per_record") & (F.col("confidence") >= LAYOUT_CONFIRMATION_BAR)
    usable = F.col("kind").isin("row_per_record", "key_value", "multiple_tables")
    go = sure | (F.coalesce("_confirmed", F.lit(False)) & usable)
    questions = marked.filter(~go).select(
        *SHEET_KEY, F.lit("layout").alias("kind"), F.concat(F.lit("layout looks like "), F.col("kind")).alias("unsure_about"),
        F.col("reasoning").alias("reason"), "confidence", usable.alias("answerable_by_hint"),
    )
    return marked.filter(go).drop("_confirmed"), questions


def structure_questions(shapes: DataFrame, grid: DataFrame) -> DataFrame:
    """A question for every sheet whose shape is not row-per-record, with its first rows."""
    asked = shapes.filter(F.col("shape") != "row_per_record")
    window = evidence_window(grid, asked.withColumn("header_row", F.lit(None).cast("bigint")))
    reason = F.when(F.col("shape") == "unknown", "the sheet holds no table rows").otherwise(
        F.concat(F.lit("the sheet looks like "), F.col("shape"), F.lit(", which is no single table"))
    )
    return asked.join(window, SHEET_KEY, "left").select(
        *SHEET_KEY, F.lit("shape").alias("kind"), F.col("shape").alias("unsure_about"), reason.alias("reason"),
        F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("answerable_by_hint"),
        "evidence_first_row", "evidence_rows",
    )


def layout_record_count(blocks: Column, melt: Column) -> Column:
    """Records a key-value layout yields: one, or the number of value columns when melting."""
    return F.when(melt, F.aggregate(blocks, F.lit(0), lambda a, b: a + F.size(b["value_columns"]))).otherwise(1)
