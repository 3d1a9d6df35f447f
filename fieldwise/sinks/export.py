"""Exports, manifests and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, slug
from ..model import SOURCE_SHEET, FieldSet
from ..operators.convert import value_source
from ..operators.matching import with_norm, with_occurrence
from ..session import settle

FORMATS = ("csv", "json", "parquet")


def export_key(vendor: Column, source_file: Column, sheet: Column) -> Column:
    """vendor__filestem__sheet; the sheet is left out where it only repeats the file."""
    stem = F.regexp_replace(F.regexp_extract(F.coalesce(source_file, F.lit("")), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    inner = F.when(F.coalesce(sheet, F.lit("")) == F.coalesce(source_file, F.lit("")), "").otherwise(slug(sheet))
    parts = F.filter(F.array(slug(vendor), slug(stem), inner), lambda p: p != "")
    return F.coalesce(F.nullif(F.array_join(parts, "__"), F.lit("")), F.lit("export"))


def export(tidy: DataFrame, ready: DataFrame, keys: DataFrame, field_set: FieldSet, path: str, fmt: str = "parquet") -> DataFrame:
    """Write ready datasets, one folder per export key; returns the refused (dataset_id) rows.

    keys: dataset_id, export_key. The fields in declared order, then the source sheet if known. A
    dataset keeps as many output tasks as its rows need: rows are spread by key and a row salt, so
    one hot dataset never lands in a single writer.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}, not {fmt!r}")
    names = [*field_set.names, *([SOURCE_SHEET] if SOURCE_SHEET in tidy.columns else [])]
    allowed = ready.filter("ready").select("dataset_id").join(keys, "dataset_id")
    out = tidy.join(allowed, "dataset_id").select(*[F.col(f"`{n}`") for n in names], "export_key", F.pmod(F.floor(F.col("row_idx") / 1_000_000), F.lit(4096)).alias("_part"))
    writer = out.repartition("export_key", "_part").drop("_part").write.mode("overwrite").partitionBy("export_key")
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)
    return ready.filter(~F.col("ready")).select("dataset_id")


def absent_fields(mappings: DataFrame) -> DataFrame:
    """Fields the source had no column for and nothing was inferred for."""
    return mappings.filter(value_source(F.col("source_column"), F.col("inferred_value")) == "absent").select("dataset_id", "target_field")


def unclaimed_columns(columns: DataFrame, mappings: DataFrame) -> DataFrame:
    """Named columns no field took."""
    claimed = mappings.filter(F.col("source_column").isNotNull()).select("dataset_id", F.col("source_column").alias("header")).distinct()
    return columns.filter(~is_blank(F.col("header"))).join(claimed, ["dataset_id", "header"], "left_anti").select("dataset_id", "col_idx", "header")


def manifests(datasets: DataFrame, columns: DataFrame, mappings: DataFrame, audit: DataFrame) -> DataFrame:
    """One audit row per dataset.

    audit: dataset_id, schema_name, vendor, confirmed_by, exported_at, provenance, strictness,
    field_set_signature, column_signature. Header and mapping inventories only; no data row is read.
    """
    first = Window.partitionBy("dataset_id", "header").orderBy("col_idx")
    places = with_occurrence(with_norm(columns, "header")).withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(
        "dataset_id", F.col("header").alias("source_column"), "norm", "occurrence"
    )
    entry = F.struct(
        "target_field", F.col("norm").alias("source_column_normalised"), F.coalesce("occurrence", F.lit(0)).alias("source_column_occurrence"),
        "inferred_value", "confidence", (~F.col("needs_confirmation")).alias("confirmed"),
        value_source(F.col("source_column"), F.col("inferred_value")).alias("value_source"),
    )
    mapped = mappings.join(places, ["dataset_id", "source_column"], "left").groupBy("dataset_id").agg(
        F.array_sort(F.collect_list(entry)).alias("field_mappings"),
        F.array_sort(F.collect_list(F.when(value_source(F.col("source_column"), F.col("inferred_value")) == "absent", F.col("target_field")))).alias("fields_absent_from_source"),
    )
    headers = columns.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", "header"))).alias("_h")).select(
        "dataset_id", F.transform("_h", lambda h: h["header"]).alias("source_columns")
    )
    left = unclaimed_columns(columns, mappings).groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", "header"))).alias("_u")).select(
        "dataset_id", F.transform("_u", lambda h: h["header"]).alias("columns_not_in_schema")
    )
    none = F.array().cast("array<string>")
    return (
        datasets.select("dataset_id", "source_file", F.col("origin_sheet").alias("source_sheet")).join(audit, "dataset_id")
        .join(mapped, "dataset_id", "left").join(headers, "dataset_id", "left").join(left, "dataset_id", "left")
        .withColumn("columns_not_in_schema", F.coalesce("columns_not_in_schema", none))
        .withColumn("source_columns", F.coalesce("source_columns", none))
    )


def safe_name(name: Column, index: Column) -> Column:
    """X6 without collisions: allowed characters only, no dot runs, no edge dots or spaces."""
    kept = F.regexp_replace(name, r"[^A-Za-z0-9._ \-]", "")
    trimmed = F.btrim(F.regexp_replace(kept, r"\.{2,}", "."), F.lit(" ."))
    return F.when(trimmed == "", F.concat(F.lit("sheet_"), index.cast("string"))).otherwise(trimmed)


def safe_names(members: DataFrame) -> DataFrame:
    """file_id, idx, name -> safe, unique inside a file by an index suffix.

    The first of equal names keeps it, later ones take their index. Only files in which such a name meets another
    are settled in rounds.
    """
    same = Window.partitionBy("file_id", "_safe").orderBy("idx")
    safe = members.select("file_id", "idx", safe_name(F.col("name"), F.col("idx")).alias("_safe")).withColumn("_k", F.row_number().over(same))
    named = safe.withColumn("safe", F.when(F.col("_k") == 1, F.col("_safe")).otherwise(F.concat_ws("_", "_safe", F.col("idx").cast("string"))))
    clashes = named.groupBy("file_id", "safe").agg(F.count("*").alias("_n")).filter("_n > 1").select("file_id").distinct()
    plain = named.join(clashes, "file_id", "left_anti").select("file_id", "idx", "safe")
    return plain.unionByName(_settle_names(safe.join(clashes, "file_id", "left_semi")))


def _settle_names(safe: DataFrame) -> DataFrame:
    """(file_id, idx, safe) as if names were given one by one, each taking its index until it is new.

    In rounds over all files: of the members that stand at one name the first keeps it, the others take their next suffix. Whoever loses a name
    loses it to an earlier member, and the name stays with one, so the fixed point is the one-by-one answer.
    """
    held = settle(safe.select("file_id", "idx", F.col("_safe").alias("safe")))
    while True:
        first = held.groupBy("file_id", "safe").agg(F.min("idx").alias("_first"))
        judged = held.join(first, ["file_id", "safe"])
        late = F.col("idx") > F.col("_first")
        if judged.filter(late).isEmpty():
            return held
        held = settle(judged.select("file_id", "idx", F.when(late, F.concat_ws("_", "safe", F.col("idx").cast("string"))).otherwise(F.col("safe")).alias("safe")))


def member_names(members: DataFrame) -> DataFrame:
    """file_id, sheet, table_idx, title, label -> member name; a repeated title gets its rows."""
    titled = F.coalesce(F.col("title"), F.lit("")) != ""
    counts = members.filter(titled).groupBy("file_id", "sheet", "title").agg(F.count("*").alias("_same"))  # untitled rows are no key
    members = members.join(counts, ["file_id", "sheet", "title"], "left").select(*members.columns, "_same")
    same = F.col("_same")
    name = (
        F.when(F.col("table_idx").isNull(), F.col("sheet"))
        .when(titled & (same == 1), F.concat_ws(" — ", "sheet", "title"))
        .when(titled, F.concat(F.concat_ws(" — ", "sheet", "title"), F.lit(" ("), F.col("label"), F.lit(")")))
        .otherwise(F.concat_ws(" — ", "sheet", "label"))
    )
    return members.withColumn("member", name).drop("_same")


def apply_selections(manifest: DataFrame, selections: DataFrame, schemas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selected rows in manifest order, rejected (file_id, error)). One bad choice rejects its file.

    manifest: file_id, sheet, table_idx, position; selections: file_id, sheet, table_idx, schema_name.
    """
    key = ["file_id", "sheet"]
    table = F.coalesce("table_idx", F.lit(-1)).alias("_t")
    offered = manifest.select(*key, table, "position")
    asked = selections.select(*key, table, "schema_name", "table_idx")
    known = schemas.select("schema_name").distinct()
    unknown = asked.join(offered, [*key, "_t"], "left_anti").select("file_id", F.concat(F.lit("no such table: "), F.col("sheet")).alias("error"))
    schemaless = asked.join(known, "schema_name", "left_anti").select("file_id", F.concat(F.lit("no such schema: "), F.col("schema_name")).alias("error"))
    rejected = unknown.unionByName(schemaless)
    good = asked.join(rejected.select("file_id").distinct(), "file_id", "left_anti").join(offered, [*key, "_t"])
    return good.select(*key, "table_idx", "schema_name", "position"), rejected
