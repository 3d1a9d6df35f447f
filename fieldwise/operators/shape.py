"""Table-shape classification of a data region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import TRANSPOSED_MARGIN, WIDE_MATRIX_MIN_COLUMNS, WIDE_MATRIX_MIN_FRACTION
from ..session import settle
from .header import SHEET_KEY, cell_identity, is_blank_row

KINDS = ("str", "num", "bool", "date")


def region_facts(region: DataFrame, keys: list[str]) -> DataFrame:
    """P8, P9, P10 and P12 in one pass over the region: one row per sheet.

    Cells are counted by column with partial sums; what is known of a whole row rides on its first cell, so rows are counted by the same aggregate.
    A sheet's columns then fold into one row. P10 per row is the share of its commonest type, column 0 left out; an empty rest counts as one.
    """
    kinds = region.select(*keys, "row_idx", "cells", F.transform("cells", lambda c: c["t"]).alias("_k"), is_blank_row(F.col("cells")).alias("_blank"))
    rest = kinds.withColumn("_rest", F.array_remove(F.slice("_k", 2, F.greatest(F.size("_k") - 1, F.lit(0))), "blank"))

    def of_kind(kind: str) -> Column:
        return F.size("_rest") - F.size(F.array_remove("_rest", kind))

    share = F.when(F.size("_rest") > 0, F.greatest(*map(of_kind, KINDS)) / F.size("_rest")).otherwise(1.0)
    rows = rest.select(*keys, "row_idx", "cells", F.size("_k").alias("_width"), "_blank", share.alias("_share"))
    # The outer form: a row without cells is still a row, and the plain one would add a filter that works the cells out a second time.
    cells = rows.select(*keys, "row_idx", "_width", "_blank", "_share", F.posexplode_outer("cells").alias("_at", "c")).withColumn("col_idx", F.coalesce("_at", F.lit(-1)))
    whole, row = F.col("col_idx") <= 0, F.col("row_idx")
    number = F.when(F.col("c.t") == "num", F.col("c.v").try_cast("double"))
    columns = cells.groupBy(*keys, "col_idx").agg(
        *[F.count_if(F.col("c.t") == k).alias(f"n_{k}") for k in KINDS], F.min(number).alias("low"), F.max(number).alias("high"),
        F.count_if(F.col("c.t").isNotNull() & (F.col("c.t") != "blank")).alias("n_filled"),
        F.max(F.when(whole, F.col("_width"))).alias("width"), F.sum(F.when(whole, F.col("_share"))).alias("shares"), F.count_if(whole).alias("n_rows"),
        F.min(F.when(whole & F.col("_blank"), row)).alias("first_blank"), F.max(F.when(whole & F.col("_blank"), row)).alias("last_blank"),
        F.min(F.when(whole & ~F.col("_blank"), row)).alias("first_filled"), F.max(F.when(whole & ~F.col("_blank"), row)).alias("last_filled"),
    )
    columns = _with_majority(columns)
    real, first = F.col("col_idx") >= 0, F.col("col_idx") == 0
    numeric = real & (F.col("n_values") >= 2) & (F.col("n_num") == F.col("n_values"))
    return columns.groupBy(*keys).agg(
        F.max("width").alias("width"), F.min("first_blank").alias("first_blank"), F.max("last_blank").alias("last_blank"),
        F.min("first_filled").alias("first_filled"), F.max("last_filled").alias("last_filled"), (F.sum("shares") / F.sum("n_rows")).alias("row_homogeneity"),
        F.coalesce(F.sum(F.when(first, F.col("n_filled"))), F.lit(0)).alias("first_values"), F.coalesce(F.sum(F.when(first, F.col("n_str"))), F.lit(0)).alias("first_strings"),
        (F.sum(F.when(real, F.col("majority"))) / F.count_if(real)).alias("column_homogeneity"),
        largest_cluster(F.collect_list(F.when(numeric, F.struct("low", "high", "col_idx")))).alias("cluster"),
    )


def largest_cluster(ranges: Column) -> Column:
    """P12 over a sheet's ranges (low, high): the size of the largest group chained by overlaps, 0 without a range. One run in order of the starts."""
    start = F.struct(F.lit(None).cast("double").alias("reach"), F.lit(0).alias("size"), F.lit(0).alias("most"))

    def step(s: Column, r: Column) -> Column:
        size = F.when(r["low"] > s["reach"], 1).otherwise(s["size"] + 1)
        return F.struct(F.greatest(s["reach"], r["high"]).alias("reach"), size.alias("size"), F.greatest(s["most"], size).alias("most"))

    return F.aggregate(F.sort_array(ranges), start, step, lambda s: s["most"])


def _with_majority(grouped: DataFrame) -> DataFrame:
    """The share of each column's commonest type; one where it has no values."""
    total = sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col(f"n_{KINDS[0]}"))
    return grouped.withColumn("n_values", total).withColumn(
        "majority",
        F.when(F.col("n_values") > 0, F.greatest(*[F.col(f"n_{k}") for k in KINDS]) / F.col("n_values")).otherwise(1.0),
    )


def unique_first_column(region: DataFrame, suspects: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct first-column texts, counted only for the sheets where the answer matters."""
    first = F.try_element_at(F.col("cells"), F.lit(1))
    values = region.join(suspects.select(*keys), keys, "left_semi").filter(first["t"] == "str").select(*keys, cell_identity(first).alias("_v"))
    return values.groupBy(*keys, "_v").agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.count("*").alias("first_distinct"))


def shape_facts(region: DataFrame, keys: list[str] = SHEET_KEY) -> DataFrame:
    """Everything P7 decides on, one row per sheet.

    The region is settled: the first columns of suspects are read from it again, and a region's cells are typed by its maker at each reading.
    """
    region = settle(region.select(*keys, "row_idx", "cells"))
    judged = settle(region_facts(region, keys).withColumn(
        "inverted", (F.col("row_homogeneity") - F.coalesce("column_homogeneity", F.lit(0.0))) >= TRANSPOSED_MARGIN
    ))
    suspects = judged.filter(F.col("inverted") & (F.col("first_values") > 0) & (F.col("first_strings") == F.col("first_values")))
    return judged.join(unique_first_column(region, suspects, keys), keys, "left")


def classify_shape(region: DataFrame, sheets: DataFrame | None = None, keys: list[str] = SHEET_KEY) -> DataFrame:
    """Keys, shape. `sheets` lists sheets that must appear even with an empty region (unknown)."""
    facts = shape_facts(region, keys)
    separated = F.coalesce(
        (F.col("first_filled") < F.col("first_blank")) & (F.col("last_filled") > F.col("last_blank")), F.lit(False)
    )
    unique = F.coalesce(F.col("first_distinct") == F.col("first_values"), F.lit(False))
    cluster = F.coalesce("cluster", F.lit(0))
    wide = (cluster >= WIDE_MATRIX_MIN_COLUMNS) & (cluster / F.col("width") >= WIDE_MATRIX_MIN_FRACTION)
    shape = (
        F.when(F.col("row_homogeneity").isNull(), "unknown")
        .when(separated, "multiple_tables")
        .when(F.col("inverted") & unique, "transposed")
        .when(F.coalesce(wide, F.lit(False)), "wide_matrix")
        .otherwise("row_per_record")
    )
    if sheets is not None:
        facts = sheets.select(*keys).distinct().join(facts, keys, "left")
    return facts.select(*keys, shape.alias("shape"))
