"""Workbooks of all kinds made of customer, a file a nation: raw cells through the ladder to mapped tables and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import HINT, Field, FieldSet
from ..plans.pipeline import field_report
from ..plans.workbook import map_workbooks, read_workbooks
from .registry import dot_money, query, sql_values, table

KEY_FIELDS = FieldSet("customers", (Field("key", "integer"), Field("name", "text"), Field("segment", "text"), Field("balance", "number")))
HEADERS = ("key", "name", "segment", "balance")
# What the file of nation n looks like: n mod 8.
PLAIN, BANNER, TWO_TABLES, PAIRS, NOTES, TWINS, MATRIX, BOUNDED = range(8)


def _entries(*values: tuple[Column, str]) -> Column:
    """A row's cells as (col_idx, v, t)."""
    return F.array(*(F.struct(F.lit(i).alias("col_idx"), v.cast("string").alias("v"), F.lit(t).alias("t")) for i, (v, t) in enumerate(values)))


FILE_KEYS = 4096  # keys that a nation's file spans


def _file() -> Column:
    return F.format_string("nation-%02d-%d.xlsx", F.col("c_nationkey"), F.floor(F.col("c_custkey") / FILE_KEYS))


def customer_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Raw cells: every customer is a row of its nation's sheet, or a column where labels run down the side."""
    customer = table(spark, sf, "customer").select(
        _file().alias("file_id"), (F.col("c_nationkey") % 8).alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"), dot_money(F.col("c_acctbal")).alias("balance"),
    )
    files = customer.groupBy("file_id", "kind").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("key")) - 1  # a file has at most FILE_KEYS rows
    placed = customer.withColumn("rank", rank).join(files.drop("kind"), "file_id")
    k = F.col("kind")
    data = _entries((F.col("key"), "num"), (F.col("name"), "str"), (F.col("segment"), "str"), (F.col("balance"), "num"))
    wide = _entries((F.col("name"), "str"), (F.col("balance"), "num"), (F.col("balance"), "num"), (F.col("balance"), "num"))
    lead = F.when(k == BANNER, 4).when(k == BOUNDED, 2).otherwise(1)
    gap = F.when((k == TWO_TABLES) & (F.col("rank") >= F.col("n") / 2), 1).otherwise(0)
    row = (F.col("rank") + lead + gap).cast("bigint")
    by_row = placed.filter(k != PAIRS).select("file_id", "kind", F.explode(F.when(k == TWINS, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("data")))).alias("sheet"), row.alias("row_idx"), F.explode(F.when(k == MATRIX, wide).otherwise(data)).alias("c"))
    down = placed.filter(k == PAIRS).select("file_id", "kind", F.lit("data").alias("sheet"), (F.col("rank") + 1).cast("int").alias("at"), F.explode(data).alias("c"))
    down = down.select("file_id", "kind", "sheet", F.col("c.col_idx").cast("bigint").alias("row_idx"), F.struct(F.col("at").alias("col_idx"), F.col("c.v").alias("v"), F.col("c.t").alias("t")).alias("c"))

    names = _entries(*((F.lit(h), "str") for h in HEADERS))
    heads = files.filter(k != PAIRS).select("file_id", "kind", F.explode(F.when(k == TWINS, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("data")))).alias("sheet"), (lead - 1).cast("bigint").alias("row_idx"), F.explode(names).alias("c"))
    labels = files.filter(k == PAIRS).select("file_id", "kind", F.lit("data").alias("sheet"), F.posexplode(F.array(*map(F.lit, HEADERS))).alias("row_idx", "label"))
    labels = labels.select("file_id", "kind", "sheet", F.col("row_idx").cast("bigint").alias("row_idx"), F.struct(F.lit(0).alias("col_idx"), F.col("label").alias("v"), F.lit("str").alias("t")).alias("c"))
    one = lambda at, text: F.struct(at.cast("bigint").alias("row_idx"), F.lit(text).alias("v"))
    extra = F.when(k == BANNER, F.array(one(F.lit(0), "Customers"), one(F.lit(1), "by nation"))).when(k == BOUNDED, F.array(one(F.lit(0), "Customers"), one(F.col("n") + 2, "end of the list")))
    blank = F.struct(F.when(k == BANNER, F.lit(2)).otherwise(F.floor((F.col("n") + 1) / 2) + 1).cast("bigint").alias("row_idx"), F.lit(None).cast("string").alias("v"))
    extra = F.when(k == TWO_TABLES, F.array(blank)).when(k == BANNER, F.concat(extra, F.array(blank))).otherwise(extra)
    loose = files.select("file_id", "kind", F.lit("data").alias("sheet"), F.explode(extra).alias("x"))
    notes = files.filter(k == NOTES).select("file_id", "kind", F.lit("notes").alias("sheet"), F.explode(F.array(one(F.lit(0), "for review"))).alias("x"))
    loose = loose.unionByName(notes).select("file_id", "kind", "sheet", F.col("x.row_idx").alias("row_idx"), F.struct(F.lit(0).alias("col_idx"), F.col("x.v").alias("v"), F.when(F.col("x.v").isNull(), "blank").otherwise("str").alias("t")).alias("c"))
    parts = by_row.unionByName(down).unionByName(heads).unionByName(labels).unionByName(loose)
    return parts.select("file_id", "sheet", "row_idx", "c.col_idx", "c.v", "c.t")


def customer_hints(spark: SparkSession, sf: str) -> DataFrame:
    """What a person answered: labels run down the side, and one list ends before its last row."""
    sizes = table(spark, sf, "customer").groupBy(_file().alias("file_id"), (F.col("c_nationkey") % 8).alias("kind")).agg(F.count("*").alias("n"))
    k, end = F.col("kind"), F.col("n")
    block = F.struct(F.lit(0).alias("label_column"), F.sequence(F.lit(1), F.col("n").cast("int")).alias("value_columns"), F.lit(0).cast("bigint").alias("first_row"), F.lit(3).cast("bigint").alias("last_row"))
    none = F.lit(None).cast("bigint")
    pairs = _layout(F.lit("key_value"), none, none, none, F.array(block), F.lit(True))
    bounded = _layout(F.lit("row_per_record"), F.lit(1).cast("bigint"), F.lit(2).cast("bigint"), end + 1, F.slice(F.array(block), 1, 0), F.lit(False))
    layout = F.when(k == PAIRS, pairs).when(k == BOUNDED, bounded)
    return sizes.filter(k.isin(PAIRS, BOUNDED)).select("file_id", F.lit(None).cast("string").alias("sheet"), _hint(layout))


def _layout(kind: Column, header: Column, first: Column, last: Column, blocks: Column, melt: Column) -> Column:
    tables = F.array().cast("array<struct<header_row_index:bigint,first_data_row:bigint,last_data_row:bigint,title_row_index:bigint>>")
    return F.struct(
        kind.alias("kind"), F.lit(1.0).alias("confidence"), header.alias("header_row_index"), first.alias("first_data_row"), last.alias("last_data_row"),
        blocks.alias("key_value_blocks"), melt.alias("one_record_per_value_column"), tables.alias("tables"),
    )


def _hint(layout: Column) -> Column:
    text = F.lit(None).cast("string")
    return F.struct(F.lit(None).cast("bigint").alias("header_row"), text.alias("sheet"), text.alias("delimiter"), text.alias("decimal_separator"), layout.alias("layout")).cast(HINT).alias("structural_hint")


SQL_FILES = f"""files as (select printf('nation-%02d-%d.xlsx', c_nationkey, c_custkey // {FILE_KEYS}) as file_id, c_nationkey % 8 as kind, count(*) as n from customer group by all),
  sheets as (select file_id, kind, n, unnest(case when kind={TWINS} then ['a','b'] when kind={NOTES} then ['data','notes'] else ['data'] end) as sheet from files),
  gates as (select *, case when sheet='notes' then 'passed_over' when kind={TWINS} then 'sheet' when kind in ({TWO_TABLES},{MATRIX}) then 'shape' when kind={PAIRS} then 'pairs' else 'rows' end as gate from sheets)"""


@query("workbook_gates", f"""with {SQL_FILES}
  select file_id, sheet, gate, case when gate not in ('rows','shape') then null when kind={BANNER} then 3 when kind={BOUNDED} then 1 else 0 end::bigint as header_row,
    case when gate in ('rows','pairs') then n else 0 end as n_rows from gates""")
def workbook_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Where every sheet stands when the ladder is done, and the records read from it."""
    book = read_workbooks(customer_cells(spark, sf), customer_hints(spark, sf))
    read = book.tables.rows.groupBy("dataset_id").agg(F.count("*").alias("n")).join(book.tables.datasets, "dataset_id").select(F.col("source_file").alias("file_id"), "sheet", "n")
    return book.state.join(read, ["file_id", "sheet"], "left").select("file_id", "sheet", "gate", "header_row", F.coalesce("n", F.lit(0)).alias("n_rows"))


@query("workbook_questions", f"""with {SQL_FILES}
  select distinct file_id, case when gate='shape' then sheet end as sheet, gate as kind, case when gate='sheet' then 'which sheet holds the data' when kind={MATRIX} then 'wide_matrix' else 'multiple_tables' end as unsure_about,
    case when gate='sheet' then 'a,b' else '' end as candidates, gate='shape' as has_rows from gates where gate in ('sheet','shape')""")
def workbook_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The one frame of questions over sheets of all kinds, mapped to the end."""
    mapped = map_workbooks(customer_cells(spark, sf), KEY_FIELDS, customer_hints(spark, sf))
    return mapped.questions.select("file_id", "sheet", "kind", "unsure_about", F.coalesce(F.array_join("alternatives", ","), F.lit("")).alias("candidates"), F.col("evidence_rows").isNotNull().alias("has_rows"))


@query("workbook_report", f"""with {SQL_FILES}
  select file_id as dataset, f.target_field, f.target_field as source_column, f.locale, n as rows, n as converted, 0 as violations, false as needs_confirmation, true as ready
  from gates, {sql_values([('key', 'decimal_point'), ('name', 'non_numeric'), ('segment', 'non_numeric'), ('balance', 'decimal_point')], ['target_field', 'locale']).replace(') AS t(', ') AS f(')} where gate in ('rows','pairs')""")
def workbook_report(spark: SparkSession, sf: str) -> DataFrame:
    """Raw cells to one report line a field: what the ladder could read is mapped, converted and checked."""
    mapped = map_workbooks(customer_cells(spark, sf), KEY_FIELDS, customer_hints(spark, sf))
    return field_report(mapped.review, mapped.workbook.tables, KEY_FIELDS)
