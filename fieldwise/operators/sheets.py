"""Sheet inventory: ranking, choice, description, corpus manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import SHEET_MARGIN, SHEET_MIN_ROWS, SHEET_WIDTH_SATURATION
from .header import SHEET_KEY, blank_cell, cell_identity, detect_header, header_texts
from .layout import unpivot_key_value
from .matching import column_signature
from .shape import classify_shape


def sheet_scores(grid: DataFrame) -> DataFrame:
    """P14 signals and score per sheet."""
    filled = F.size(F.filter("cells", lambda c: ~blank_cell(c)))
    placed = ["sheet_idx"] if "sheet_idx" in grid.columns else []
    sizes = grid.select(*SHEET_KEY, *placed, "row_idx", F.size("cells").alias("_w"), filled.alias("_f")).groupBy(*SHEET_KEY).agg(
        *(F.min(c).alias(c) for c in placed), (F.max("row_idx") + 1).alias("n_rows"), F.max("_w").alias("n_cols"), F.sum("_f").alias("n_filled")
    )
    first = F.try_element_at(F.col("cells"), F.lit(1))
    firsts = (
        grid.filter(first["t"] != "blank").select(*SHEET_KEY, cell_identity(first).alias("_v"))
        .groupBy(*SHEET_KEY, "_v").agg(F.count("*").alias("_n"))
        .groupBy(*SHEET_KEY).agg((F.count("*") / F.sum("_n")).alias("uniqueness"))
    )
    widest = F.max("n_cols").over(Window.partitionBy("file_id")) * SHEET_WIDTH_SATURATION
    area = F.col("n_rows") * F.col("n_cols")
    joined = sizes.join(firsts, SHEET_KEY, "left").withColumn("_widest", widest)
    score = (
        0.3 * F.when(area > 0, F.col("n_filled") / area).otherwise(0.0)
        + 0.4 * F.when(F.col("_widest") > 0, F.least(F.col("n_cols") / F.col("_widest"), F.lit(1.0))).otherwise(0.0)
        + 0.2 * F.least(F.col("n_rows") / SHEET_MIN_ROWS, F.lit(1.0))
        + 0.1 * F.coalesce("uniqueness", F.lit(0.0))
    )
    return joined.select(*SHEET_KEY, *placed, "n_rows", "n_cols", score.alias("score"))


def rank_sheets(grid: DataFrame) -> DataFrame:
    """file_id, sheet, score, rank, confident (true on every row of a clearly won file)."""
    scored = sheet_scores(grid)
    place = "sheet_idx" if "sheet_idx" in scored.columns else "sheet"  # workbook order where the grid tells it
    order = Window.partitionBy("file_id").orderBy(F.col("score").desc(), place)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top, second = F.nth_value("score", 1).over(whole), F.nth_value("score", 2).over(whole)
    return scored.select(
        *SHEET_KEY, "score", F.row_number().over(order).alias("rank"),
        F.coalesce((top - second) >= SHEET_MARGIN, F.lit(True)).alias("confident"),
    )


def choose_sheet(ranking: DataFrame, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P20: (chosen, questions, errors). An explicit answer wins; one sheet or a clear winner is taken."""
    files = ranking.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "sheet"))).alias("_s"), F.bool_and("confident").alias("confident")
    ).withColumn("sheets", F.transform("_s", lambda s: s["sheet"]))
    if answers is None:
        asked = files.withColumn("answer", F.lit(None).cast("string"))
    else:
        asked = files.join(answers.select("file_id", F.col("sheet").alias("answer")), "file_id", "left")
    known = F.array_contains("sheets", F.col("answer"))
    chosen = asked.filter(F.coalesce(known, F.col("answer").isNull() & F.col("confident"))).select(
        "file_id", F.coalesce("answer", F.element_at("sheets", 1)).alias("sheet")
    )
    questions = asked.filter(F.col("answer").isNull() & ~F.col("confident")).select(
        "file_id", F.lit("sheet").alias("kind"), F.col("sheets").alias("candidates")
    )
    errors = asked.filter(F.col("answer").isNotNull() & ~known).select(
        "file_id", F.concat(F.lit("no sheet named '"), F.col("answer"), F.lit("'")).alias("error")
    )
    return chosen, questions, errors


def describe_sheets(grid: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """file_id, sheet, status, headers, row_count for every sheet; none is dropped.

    Gates in order: shape (or the given verdict), then header confidence. A key-value sheet's headers are its
    labels; unreadable shapes claim none.
    """
    detected = detect_header(grid)
    cut = detected.select(*SHEET_KEY, F.coalesce("header_row", F.lit(-1)).alias("_h"))
    region = grid.join(cut, SHEET_KEY).filter(F.col("row_idx") > F.col("_h"))
    shapes = classify_shape(region, detected)
    joined = detected.join(shapes, SHEET_KEY)

    def header_at(index):
        return F.element_at(F.filter("head", lambda r: r["row_idx"] == index), 1)["cells"]

    unsure = F.col("header_row").isNull() | ~F.col("confident")
    below = F.col("n_rows") - F.coalesce(F.col("header_row") + 1, F.lit(0))
    if layouts is None:
        status = F.when(F.col("shape") != "row_per_record", "unsupported_shape").when(unsure, "header_uncertain").otherwise("ok")
        named = F.when((F.col("shape") == "row_per_record") & F.col("header_row").isNotNull(), header_texts(header_at(F.col("header_row"))))
        count = below
    else:
        verdict = layouts.select(
            *SHEET_KEY, F.col("kind").alias("_kind"), F.col("header_row_index").alias("_hri"), F.col("first_data_row").alias("_first"),
            F.col("last_data_row").alias("_last"), "key_value_blocks", "one_record_per_value_column",
        )
        joined = joined.join(verdict, SHEET_KEY, "left")
        kind = F.coalesce("_kind", F.lit("unknown"))
        blocks = F.coalesce(F.size("key_value_blocks"), F.lit(0)) > 0
        index = F.when(F.col("_hri").between(0, F.col("n_rows") - 1), F.col("_hri")).otherwise(F.col("header_row"))
        status = (
            F.when(kind == "key_value", F.when(blocks, "ok").otherwise("layout_unknown"))
            .when(kind == "row_per_record", F.when(unsure, "header_uncertain").otherwise("ok"))
            .when(kind.isin("wide_matrix", "multiple_tables", "not_a_table"), "unsupported_shape")
            .otherwise("layout_unknown")
        )
        labelled = unpivot_key_value(grid, layouts)
        labels = labelled.datasets.select("dataset_id", F.col("source_file").alias("file_id"), "sheet").join(
            labelled.columns.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", "header"))).alias("_labels")), "dataset_id"
        ).drop("dataset_id")
        joined = joined.join(labels, SHEET_KEY, "left")
        named = F.when((kind == "row_per_record") & index.isNotNull(), header_texts(header_at(index))).when(
            (kind == "key_value") & blocks, F.transform("_labels", lambda x: x["header"])
        )
        records = F.when(
            F.col("one_record_per_value_column"),
            F.aggregate("key_value_blocks", F.lit(0), lambda a, b: a + F.size(b["value_columns"])),
        ).otherwise(1)
        count = (
            F.when((kind == "key_value") & blocks, records.cast("bigint"))
            .when(
                kind == "row_per_record",
                F.when(F.col("_first").isNotNull() & F.col("_last").isNotNull(), F.greatest(F.col("_last") - F.col("_first") + 1, F.lit(0)))
                .otherwise(F.col("n_rows") - F.coalesce(index + 1, F.lit(0))),
            )
            .otherwise(below)
        )
    return joined.select(
        *SHEET_KEY, status.alias("status"),
        F.coalesce(named, F.array().cast("array<string>")).alias("headers"), count.alias("row_count"),
    )


def describe_corpus(described: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """The sheet descriptions with their column signature (blank without headers) and proposals.

    described: dataset_id plus the P21 columns; scored: the M15 output.
    """
    columns = described.select("dataset_id", F.posexplode("headers").alias("col_idx", "header"))
    result = described.join(column_signature(columns), "dataset_id", "left").withColumn(
        "column_signature", F.coalesce("column_signature", F.lit(""))
    )
    if scored is None:
        return result
    proposals = scored.groupBy("dataset_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "schema_name", "score", "source"))).alias("proposals")
    )
    return result.join(proposals, "dataset_id", "left")
