"""Header-row detection on typed grids (H0-H5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import FLOAT_TEXT
from ..functions.dates import shape_of
from ..functions.text import strip
from ..model import EVIDENCE_ROWS, HEADER_MARGIN, HEADER_SCAN_ROWS, HEADER_TYPE_WINDOW
from ..session import settle

SHEET_KEY = ["file_id", "sheet"]


def infer_type(text: Column) -> Column:
    """H0 for stripped text, which carries no cell types. Only text that starts like a number meets a pattern."""
    first = F.ascii(text)
    numeric = first.between(48, 57) | first.isin(43, 45, 46)
    return (
        F.when(text.isNull() | (text == ""), "blank")
        .when(numeric, F.when(text.rlike(FLOAT_TEXT), "num").when(shape_of(text).isin("iso", "dm"), "date").otherwise("str"))
        .when(F.length(text).isin(4, 5) & F.lower(text).isin("true", "false"), "bool")
        .otherwise("str")
    )


def type_cells(rows: DataFrame) -> DataFrame:
    """H0: string cells as typed cells; blanks lose their text. Each cell is stripped once."""
    stripped = F.transform("cells", lambda v: F.struct(v.alias("v"), strip(v).alias("s")))
    return rows.withColumn(
        "cells", F.transform(stripped, lambda c: F.struct(F.when(c["s"] != "", c["v"]).alias("v"), infer_type(c["s"]).alias("t")))
    )


def blank_cell(c: Column) -> Column:
    return c["v"].isNull() | (c["t"] == "blank") | (strip(c["v"]) == "")


def is_blank_row(cells: Column) -> Column:
    """P13."""
    return F.forall(cells, blank_cell)


def cell_identity(c: Column) -> Column:
    """A cell as a comparable value: numbers by value, everything else by text."""
    number = F.when(c["t"] == "num", c["v"].try_cast("double").cast("string"))
    return F.concat_ws("\x1f", c["t"], F.coalesce(number, c["v"]))


def _consistency(candidate: Column, below: Column) -> Column:
    """H2: share of the candidate's columns whose next values have one single type."""

    def kinds(j: Column) -> Column:
        return F.filter(
            F.transform(below, lambda r: F.try_element_at(r["cells"], j + 1)["t"]),
            lambda t: t.isNotNull() & (t != "blank"),
        )

    columns = F.transform(F.sequence(F.lit(0), F.size(candidate) - 1), kinds)
    checked = F.filter(columns, lambda k: F.size(k) >= 2)
    same = F.filter(checked, lambda k: F.size(F.array_distinct(k)) == 1)
    return F.when(F.size(checked) > 0, F.size(same) / F.size(checked)).otherwise(0.0)


def grid_heads(grid: DataFrame, keys: list[str] = SHEET_KEY, depth: int = HEADER_SCAN_ROWS + HEADER_TYPE_WINDOW + 1) -> DataFrame:
    """The true size of every sheet and its first few rows: at most `depth` rows per sheet ever move."""
    lead = F.when(F.col("row_idx") < depth, F.struct("row_idx", "cells"))
    return grid.groupBy(*keys).agg(
        (F.max("row_idx") + 1).alias("n_rows"),
        F.max(F.size("cells")).alias("width"),
        F.array_sort(F.collect_list(lead)).alias("head"),
    )


def score_heads(heads: DataFrame, max_scan: int = HEADER_SCAN_ROWS) -> DataFrame:
    """H1 and H2: adds `scores` array<struct<row_idx, score>>; blank rows and the last row never score."""
    limit = F.least(F.lit(max_scan), F.greatest(F.col("n_rows") - 1, F.lit(0)))

    def score(r: Column) -> Column:
        filled = F.filter(r["cells"], lambda c: ~blank_cell(c))
        below = F.filter(
            F.col("head"), lambda b: (b["row_idx"] > r["row_idx"]) & (b["row_idx"] <= r["row_idx"] + HEADER_TYPE_WINDOW)
        )
        n = F.size(filled)
        texts = F.size(F.filter(filled, lambda c: c["t"] == "str")) / n
        unique = F.size(F.array_distinct(F.transform(filled, cell_identity))) / n
        return F.struct(
            r["row_idx"].alias("row_idx"),
            (0.3 * texts + 0.2 * unique + 0.2 * (n / F.col("width")) + 0.3 * _consistency(r["cells"], below)).alias("score"),
        )

    scanned = F.filter("head", lambda r: (r["row_idx"] < limit) & ~is_blank_row(r["cells"]))
    return heads.withColumn("scores", F.transform(scanned, score))


def score_header_rows(grid: DataFrame, keys: list[str] = SHEET_KEY, max_scan: int = HEADER_SCAN_ROWS) -> DataFrame:
    """H1: keys, row_idx, score."""
    return score_heads(grid_heads(grid, keys), max_scan).select(*keys, F.inline("scores"))


def detect_header(grid: DataFrame, keys: list[str] = SHEET_KEY) -> DataFrame:
    """H3: keys, header_row, confident, n_rows, width, head. Best score wins, ties the lowest row."""
    scored = score_heads(grid_heads(grid, keys))
    ranked = F.array_sort(F.transform("scores", lambda s: F.struct((-s["score"]).alias("_neg"), s["row_idx"].alias("row_idx"))))
    top, second = F.try_element_at(F.col("_ranked"), F.lit(1)), F.try_element_at(F.col("_ranked"), F.lit(2))
    return scored.withColumn("_ranked", ranked).select(
        *keys,
        top["row_idx"].alias("header_row"),
        F.when(F.size("_ranked") == 0, False)
        .when(F.size("_ranked") == 1, True)
        .otherwise((second["_neg"] - top["_neg"]) >= HEADER_MARGIN)
        .alias("confident"),
        "n_rows", "width", "head",
    )


def header_texts(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.coalesce(strip(c["v"]), F.lit("")))


def header_questions(detected: DataFrame, keys: list[str] = SHEET_KEY) -> DataFrame:
    """H5: a question with the best guess and the first rows wherever the header is unsure."""
    rows = F.transform(
        F.filter("head", lambda r: r["row_idx"] < EVIDENCE_ROWS),
        lambda r: F.transform(r["cells"], lambda c: F.coalesce(c["v"], F.lit(""))),
    )
    return detected.filter(~F.col("confident")).select(
        *keys,
        F.lit("header_row").alias("kind"),
        F.lit("which row holds the column names").alias("unsure_about"),
        F.lit("no row stands out clearly as the header").alias("reason"),
        F.col("header_row").alias("proposal"),
        F.lit(True).alias("answerable_by_hint"),
        F.lit(0).cast("bigint").alias("evidence_first_row"),
        rows.alias("evidence_rows"),
    )


def _spelled(label: Column, k: Column, style: str) -> Column:
    if style == "paren":
        return F.when(k == 1, label).otherwise(F.concat(label, F.lit(" ("), k.cast("string"), F.lit(")")))
    return F.when(k == 1, label).otherwise(F.concat(label, F.lit("."), (k - 1).cast("string")))


def disambiguate_labels(columns: DataFrame, style: str = "paren") -> DataFrame:
    """H4: repeated header texts made distinct per dataset, blanks left blank.

    `paren` gives `X (2)` (un-pivoted labels), `dot` gives `X.1` (delimited text). Numbering by
    occurrence is exact unless a numbered name is also some genuine label; only such datasets
    fold their list left to right, skipping suffixes already in use.
    """
    same = Window.partitionBy("dataset_id", "header").orderBy("col_idx")
    ranked = columns.select("dataset_id", "col_idx", "header", F.row_number().over(same).alias("_k"))
    named = settle(ranked.withColumn("_name", F.when(F.col("header") == "", "").otherwise(_spelled(F.col("header"), F.col("_k"), style))))
    made = named.filter((F.col("_k") > 1) & (F.col("header") != "")).select("dataset_id", F.col("_name").alias("header"))
    # Only a label that ends like a numbered name can be one: the others need no look-up.
    alike = named.filter(F.col("header").rlike(r" \([0-9]+\)$" if style == "paren" else r"\.[0-9]+$")).select("dataset_id", "header")
    clashes = settle(made.join(alike, ["dataset_id", "header"], "left_semi").select("dataset_id").distinct())
    plain = named.join(clashes, "dataset_id", "left_anti").select("dataset_id", "col_idx", F.col("_name").alias("header"))
    return plain.unionByName(_fold_labels(named.select("dataset_id", "col_idx", "header").join(clashes, "dataset_id", "left_semi"), style))


def _fold_labels(columns: DataFrame, style: str) -> DataFrame:
    lists = columns.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", "header"))).alias("_h"))
    shape = "array<struct<label:string,k:int,chosen:string>>"

    def fold(state: Column, h: Column) -> Column:
        label = h["header"]
        last = F.coalesce(F.array_max(F.transform(F.filter(state, lambda s: s["label"] == label), lambda s: s["k"])), F.lit(0))
        used = F.transform(state, lambda s: s["chosen"])
        options = F.sequence(last + 1, last + 1 + F.size(state))
        k = F.element_at(F.filter(options, lambda n: ~F.array_contains(used, _spelled(label, n, style))), 1)
        blank = F.struct(label.alias("label"), F.lit(0).alias("k"), F.lit("").alias("chosen"))
        fresh = F.struct(label.alias("label"), k.alias("k"), _spelled(label, k, style).alias("chosen"))
        return F.concat(state, F.array(F.when(label == "", blank).otherwise(fresh)))

    folded = lists.select("dataset_id", "_h", F.aggregate("_h", F.array().cast(shape), fold).alias("_f"))
    return folded.select(
        "dataset_id",
        F.inline(F.zip_with("_h", "_f", lambda h, f: F.struct(h["col_idx"].alias("col_idx"), f["chosen"].alias("header")))),
    )
