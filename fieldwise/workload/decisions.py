"""Answers from people and callables: hints, verdicts, rankings, drafts, presets and maps, over customer, part and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import HINT
from ..operators import closures, dictionary, evidence, header, layout, matching, sheets
from ..operators.common import union_all
from ..plans.schemas import choose_schemas
from .governance import EPOCH, SQL_FIELDS, alias_rows, field_rows
from .matching import NORM, SQL_CC, SQL_SIG, customer_columns
from .registry import query, table
from .structure import typed

BLOCKS = "array<struct<label_column:int,value_columns:array<int>,first_row:bigint,last_row:bigint>>"
TABLES = "array<struct<header_row_index:bigint,first_data_row:bigint,last_data_row:bigint,title_row_index:bigint>>"


def _key(name: str = "c_custkey"):
    return F.concat(F.lit("customer-"), F.col(name).cast("string"))


def small_grid(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet per customer: three rows of a label and a value, every eleventh customer's a third column."""
    k = F.col("c_custkey")
    third = F.when(k % 11 == 0, F.array(F.lit("note"))).otherwise(F.array().cast("array<string>"))
    rows = [("Name", F.col("c_name")), ("Segment", F.col("c_mktsegment")), ("Balance", F.col("c_nationkey").cast("string"))]
    cells = F.array(*[F.concat(F.array(F.lit(label), value), third) for label, value in rows])
    wide = table(spark, sf, "customer").select(F.lit("book").alias("file_id"), _key().alias("sheet"), F.posexplode(cells).alias("row_idx", "cells"))
    return typed(wide.withColumn("row_idx", F.col("row_idx").cast("bigint")))


def small_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """A key-value verdict per customer; some have no block, some reach below the sheet."""
    k = F.col("c_custkey")
    block = F.struct(F.lit(0).alias("label_column"), F.array(F.lit(1)).alias("value_columns"), F.lit(0).cast("bigint").alias("first_row"), (k % 5).cast("bigint").alias("last_row"))
    none = F.lit(None).cast("bigint")
    return table(spark, sf, "customer").select(
        F.lit("book").alias("file_id"), _key().alias("sheet"), F.lit("key_value").alias("kind"), F.lit(0.9).alias("confidence"), F.lit("judged").alias("reasoning"),
        none.alias("header_row_index"), none.alias("first_data_row"), none.alias("last_data_row"),
        F.when(k % 4 == 0, F.array().cast(BLOCKS)).otherwise(F.array(block).cast(BLOCKS)).alias("key_value_blocks"), F.lit(False).alias("one_record_per_value_column"), F.array().cast(TABLES).alias("tables"),
    )


@query("unreadable_blocks", "select 'customer-'||cast(c_custkey as varchar) as sheet, 'layout' as kind from customer where c_custkey%4=0 or c_custkey%5>2")
def unreadable_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return layout.unreadable_blocks(small_grid(spark, sf), small_layouts(spark, sf)).select("sheet", "kind")


@query(
    "sheet_labels",
    """select 'customer-'||cast(c_custkey as varchar) as sheet, case when c_custkey%4=0 or c_custkey%5>2 then 'layout_unknown' else 'ok' end as status,
      case when c_custkey%4=0 or c_custkey%5>2 then '' when c_custkey%5=0 then 'Name' when c_custkey%5=1 then 'Name,Segment' else 'Name,Segment,Balance' end as headers from customer""",
)
def sheet_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Key-value sheets are described by their labels."""
    grid, verdicts = small_grid(spark, sf), small_layouts(spark, sf)
    closed = layout.close_layouts(verdicts.withColumn("position", F.lit(0)), grid)
    described = sheets.describe_sheets(grid, closed)
    return described.select("sheet", "status", F.array_join("headers", ",").alias("headers"))


@query(
    "hinted_layouts",
    """select 'customer-'||cast(c_custkey as varchar) as sheet, case when c_custkey%3=0 then 'row_per_record' else 'multiple_tables' end as kind, case when c_custkey%3=0 then 1.0 else 0.5 end::double as confidence,
      case when c_custkey%3=0 then c_custkey%7 end as header_row_index, case when c_custkey%3=1 then 2 end as first_data_row from customer where c_custkey%3<2""",
)
def hinted_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the customers answered with a header row, a third with a layout, a third not at all."""
    k = F.col("c_custkey")
    given = F.struct(
        F.lit("multiple_tables").alias("kind"), F.lit(0.5).alias("confidence"), F.lit(None).cast("bigint").alias("header_row_index"), F.lit(2).cast("bigint").alias("first_data_row"),
        F.lit(None).cast("bigint").alias("last_data_row"), F.array().cast(BLOCKS).alias("key_value_blocks"), F.lit(False).alias("one_record_per_value_column"), F.array().cast(TABLES).alias("tables"),
    )
    hint = F.struct(
        F.when(k % 3 == 0, k % 7).cast("bigint").alias("header_row"), F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("string").alias("delimiter"),
        F.lit(None).cast("string").alias("decimal_separator"), F.when(k % 3 == 1, given).alias("layout"),
    )
    hints = table(spark, sf, "customer").select(F.lit("book").alias("file_id"), _key().alias("sheet"), hint.cast(HINT).alias("structural_hint"))
    return layout.layout_from_hints(hints).select("sheet", "kind", "confidence", "header_row_index", "first_data_row")


@query("layout_counts", "select 'customer-'||cast(c_custkey as varchar) as sheet, case when c_custkey%2=1 then 1+c_custkey%3+1 else 1 end as n_records from customer")
def layout_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Records of key-value layouts: one, or one for each value column of both blocks."""
    k = F.col("c_custkey")
    spans = F.array(F.array(F.lit(1)), F.sequence(F.lit(1).cast("bigint"), k % 3 + 1))
    blocks = F.transform(spans, lambda s: F.struct(s.alias("value_columns")))
    return table(spark, sf, "customer").select(_key().alias("sheet"), layout.layout_record_count(blocks, k % 2 == 1).cast("bigint").alias("n_records"))


@query(
    "header_doubts",
    "select 'customer-'||cast(c_custkey as varchar) as sheet, 'header_row' as kind, true as answerable_by_hint, 4 as n_shown, 'a '||c_name as first_cell from customer",
)
def header_doubts(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets of texts in which no row stands out: each is asked about, its first rows shown."""
    lines = F.array(*[F.array(F.concat(F.lit(f"{x} "), F.col("c_name")), F.concat(F.col("c_name"), F.lit(f" {x}"))) for x in "abcd"])
    wide = table(spark, sf, "customer").select(F.lit("book").alias("file_id"), _key().alias("sheet"), F.posexplode(lines).alias("row_idx", "cells"))
    asked = header.header_questions(header.detect_header(typed(wide.withColumn("row_idx", F.col("row_idx").cast("bigint")))))
    return asked.select("sheet", "kind", "answerable_by_hint", F.size("evidence_rows").alias("n_shown"), F.get(F.get("evidence_rows", F.lit(0)), F.lit(0)).alias("first_cell"))


@query(
    "judged_layouts",
    """select 'customer-'||cast(c_custkey as varchar) as sheet, case when c_custkey%11=0 then 'unknown' else 'key_value' end as kind, case when c_custkey%11=0 then 0.0 else 0.8 end::double as confidence from customer""",
)
def judged_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """A judge that sees only types and lengths answers for sheets of two columns, and names rows others don't have."""

    def judge(seen: DataFrame) -> DataFrame:
        wide = F.col("n_cols") > 2
        block = F.struct(F.lit(0).alias("label_column"), F.array(F.lit(1)).alias("value_columns"), F.lit(0).cast("bigint").alias("first_row"), F.lit(2).cast("bigint").alias("last_row"))
        none = F.lit(None).cast("bigint")
        return seen.select("file_id", "sheet", "n_cols").distinct().select(
            "file_id", "sheet", F.lit("key_value").alias("kind"), F.lit(0.8).alias("confidence"), F.lit("two columns").alias("reasoning"), F.when(wide, 99).cast("bigint").alias("header_row_index"),
            none.alias("first_data_row"), none.alias("last_data_row"), F.array(block).cast(BLOCKS).alias("key_value_blocks"), F.lit(False).alias("one_record_per_value_column"), F.array().cast(TABLES).alias("tables"),
        )

    return layout.judge_layouts(small_grid(spark, sf), None, judge, evidence.redact_to_types).select("sheet", "kind", "confidence")


@query("headers_alone", f"with {SQL_CC} select dataset_id, col_idx, header, case when col_idx=1 then 'decimal_comma' end as locale from cc")
def headers_alone(spark: SparkSession, sf: str) -> DataFrame:
    annotated = customer_columns(spark, sf).withColumn("locale", F.when(F.col("col_idx") == 1, "decimal_comma")).withColumn("values", F.array(F.lit("secret")))
    return evidence.headers_only(annotated)


@query(
    "corpus_manifest",
    f"""with {SQL_SIG}, e as (select c_custkey, 'customer-'||cast(c_custkey as varchar) as dataset_id from customer)
      select e.dataset_id, case when e.c_custkey%6=5 then 'unsupported_shape' else 'ok' end as status, case when e.c_custkey%6=5 then '' else sig.column_signature end as column_signature, case when e.c_custkey%6=5 then 0 else 5 end as n_headers
      from e join sig on sig.dataset_id=e.dataset_id""",
)
def corpus_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Sheet descriptions with signatures; a sheet without headers has a blank one."""
    unread = F.regexp_extract("dataset_id", "([0-9]+)$", 1).cast("bigint") % 6 == 5
    lists = customer_columns(spark, sf).groupBy("dataset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "header"))), lambda x: x["header"]).alias("_h"))
    described = lists.select(
        "dataset_id", F.when(unread, "unsupported_shape").otherwise("ok").alias("status"), F.when(unread, F.array().cast("array<string>")).otherwise(F.col("_h")).alias("headers")
    )
    return sheets.describe_corpus(described).select("dataset_id", "status", "column_signature", F.size("headers").alias("n_headers"))


@query(
    "hint_replay",
    """select 'customer-'||cast(c_custkey as varchar) as file_id, 'profile '||c_mktsegment as profile_id, 1 as header_row from customer where c_mktsegment<>'MACHINERY'""",
)
def hint_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets with an open header question; each segment has a saved hint that fits and an older one that names the wrong row."""
    customer = table(spark, sf, "customer")
    lines = F.array(F.array(F.lit("title"), F.lit("")), F.array(F.lit("Name "), F.col("c_mktsegment")))
    grid = typed(customer.select(_key().alias("file_id"), F.lit("s").alias("sheet"), F.posexplode(lines).alias("row_idx", "cells")).withColumn("row_idx", F.col("row_idx").cast("bigint")))
    questions = customer.select(_key().alias("file_id"), F.lit("s").alias("sheet"), F.lower("c_mktsegment").alias("field_set_signature"))
    segments = customer.select("c_mktsegment").distinct().filter("c_mktsegment <> 'MACHINERY'")
    signed = matching.column_signature(segments.select(F.col("c_mktsegment").alias("dataset_id"), F.posexplode(F.array(F.lit("name"), F.lower("c_mktsegment"))).alias("col_idx", "header")))

    def saved(row: int, name, at: str) -> DataFrame:
        hint = F.struct(
            F.lit(row).cast("bigint").alias("header_row"), F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("string").alias("delimiter"), F.lit(None).cast("string").alias("decimal_separator"),
            F.from_json(F.lit("null"), HINT)["layout"].alias("layout"),
        )
        return signed.select(
            F.lower("dataset_id").alias("field_set_signature"), "column_signature", F.concat(F.lit(name), F.col("dataset_id")).alias("profile_id"), F.lit(at).cast("timestamp").alias("created_at"), hint.alias("structural_hint"),
        )

    profiles = saved(0, "old ", "2023-01-01").unionByName(saved(1, "profile ", "2024-01-01")).unionByName(saved(1, "third ", "2025-01-01"))
    return matching.replay_hints(questions, profiles, grid).select("file_id", "profile_id", "header_row")


def segment_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """A schema for each of the first segments by name, with the segment as its only field."""
    segments = table(spark, sf, "customer").select("c_mktsegment").distinct().filter("c_mktsegment < 'G'")
    return segments.select(F.concat(F.lit("schema "), F.col("c_mktsegment")).alias("schema_name"), F.lit(0).alias("pos"), F.lower("c_mktsegment").alias("name"))


SQL_OPEN = f"""{SQL_CC}, sg as (select distinct lower(c_mktsegment) as name from customer where c_mktsegment<'G'), n as (select cc.*, {NORM.format('header')} as norm from cc),
  op as (select * from n where dataset_id not in (select dataset_id from n join sg on norm=name))"""


def _second_answer(unsure: str):
    """A ranker that names no known schema first, and has nothing to say about one kind of dataset."""

    def ranker(open_datasets: DataFrame, columns: DataFrame) -> DataFrame:
        named = matching.with_norm(columns, "header").filter(F.col("norm") == unsure).select("dataset_id").distinct()
        told = F.array(
            F.struct(F.lit(0).alias("position"), F.lit("ghost").alias("schema_name"), F.lit("first").alias("reason")),
            F.struct(F.lit(1).alias("position"), F.lit("schema BUILDING").alias("schema_name"), F.lit("second").alias("reason")),
        )
        return open_datasets.join(named, "dataset_id", "left_anti").select("dataset_id", F.inline(told))

    return ranker


@query("ranked_unmatched", f"""with {SQL_OPEN} select distinct dataset_id, 'schema BUILDING' as schema_name, 'second' as reason from op where dataset_id not in (select dataset_id from n where norm='machinery')""")
def ranked_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """A ranker for the datasets that no schema covers: its first answer names no schema there is, its second counts."""
    columns, ranker = customer_columns(spark, sf), _second_answer("machinery")
    return choose_schemas(columns, segment_schemas(spark, sf), ranker=lambda asked: ranker(asked, columns)).suggestions


@query(
    "drafted_schemas",
    f"""with {SQL_OPEN}, f as (select *, row_number() over (partition by dataset_id, norm order by col_idx) as r from op where dataset_id in (select dataset_id from n where norm='machinery'))
      select dataset_id, header as source_header, norm as name from f where r=1""",
)
def drafted_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """A drafter that names every column after its header, for the datasets that neither a schema nor the ranker knows."""
    columns, ranker = customer_columns(spark, sf), _second_answer("machinery")

    def drafter(shown: DataFrame, sample: DataFrame | None) -> DataFrame:
        assert sample is None
        return matching.with_norm(shown, "header", "name").select(
            "dataset_id", F.col("col_idx").alias("position"), F.col("col_idx").alias("column_index"), "name", F.lit("text").alias("type"), F.lit(True).alias("required"), F.lit("header").alias("reason")
        )

    return choose_schemas(columns, segment_schemas(spark, sf), ranker=lambda asked: ranker(asked, columns), drafter=drafter).drafts.select("dataset_id", "source_header", "name")


@query("seam_failures", f"""with {SQL_OPEN} select 'sound' as ranker, count(distinct dataset_id) as n_suggestions, 0 as n_errors from op
  union all select 'fails in a task', 0, 1 union all select 'fails in planning', 0, 1""")
def seam_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Three rankers over the same open datasets: one that fails, wherever it does, costs its suggestions and leaves an error, never the plan."""
    columns, schemas = customer_columns(spark, sf), segment_schemas(spark, sf)
    sound = _second_answer("nothing")

    def broken(asked: DataFrame) -> DataFrame:
        raise ConnectionError("no answer")

    rankers = {
        "sound": lambda asked: sound(asked, columns),
        "fails in a task": lambda asked: sound(asked, columns).withColumn("reason", F.when(F.col("position") == 1, F.raise_error(F.lit("no answer"))).otherwise(F.col("reason"))),
        "fails in planning": broken,
    }
    lines = []
    for name, ranker in rankers.items():
        choice = choose_schemas(columns, schemas, ranker=ranker)
        told = choice.suggestions.select(F.lit(1).alias("s"), F.lit(0).alias("e")).unionByName(choice.errors.select(F.lit(0).alias("s"), F.lit(1).alias("e")))
        lines.append(told.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("n_suggestions"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_errors")).select(F.lit(name).alias("ranker"), "n_suggestions", "n_errors"))
    return union_all(lines)


@query("preset_seeds", "select 'set '||p_type as name, case when p_type<'M' then 'mine' else 'preset' end as fields from (select distinct p_type from part)")
def preset_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Presets for every part type; those there already stay as they are, repeated ones count once."""
    named = table(spark, sf, "part").select(F.concat(F.lit("set "), F.col("p_type")).alias("name"), "p_type")
    at = F.lit(EPOCH).cast("timestamp").alias("created_at")
    stored = named.filter("p_type < 'M'").distinct().select("name", F.lit("mine").alias("fields"), at)
    return dictionary.seed_presets(stored, named.select("name", F.lit("preset").alias("fields"), at)).select("name", "fields")


@query(
    "profile_documents",
    """select c_custkey as profile_id, '[{"target_field":"key","source_column_normalised":"'||lower(c_name)||'","source_column_occurrence":0,"inferred_value":null}]' as field_mappings, c_custkey%5 as header_row from customer""",
)
def profile_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A profile's nested parts as JSON text and back."""
    entry = F.struct(
        F.lit("key").alias("target_field"), F.lower("c_name").alias("source_column_normalised"), F.lit(0).alias("source_column_occurrence"), F.lit(None).cast("string").alias("inferred_value")
    )
    hint = F.struct(
        (F.col("c_custkey") % 5).alias("header_row"), F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("string").alias("delimiter"), F.lit(None).cast("string").alias("decimal_separator"),
        F.from_json(F.lit("null"), HINT)["layout"].alias("layout"),
    )
    profiles = table(spark, sf, "customer").select(F.col("c_custkey").alias("profile_id"), F.array(entry).alias("field_mappings"), hint.alias("structural_hint"))
    stored = dictionary.profile_json(profiles)
    back = dictionary.from_profile_json(stored)
    return stored.select("profile_id", "field_mappings").join(back.select("profile_id", F.col("structural_hint.header_row").alias("header_row")), "profile_id")


@query(
    "map_imports",
    f"""with {SQL_FIELDS} select p_brand as from_brand, name, coalesce(n_aliases, 0) as n_aliases from (select schema_id as p_brand, field_id, name from fl where removed_at is null) f
      left join (select 'f'||cast(l_partkey as varchar) as field_id, count(distinct l_suppkey) as n_aliases from lineitem where l_suppkey%7<>0 group by 1) a using (field_id)""",
)
def map_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Every brand's dictionary exported as a map and imported into one empty schema: all fields and live aliases arrive."""
    fields = field_rows(spark, sf)
    brands = table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("seq"))
    at = F.lit(EPOCH).cast("timestamp")
    schemas = brands.select(
        F.col("p_brand").alias("schema_id"), F.col("p_brand").alias("schema_name"), F.lit("seed").alias("created_by"), at.alias("created_at"), "seq",
        F.lit(None).cast("timestamp").alias("removed_at"), F.lit(None).cast("string").alias("removed_by"),
    )
    maps = dictionary.export_master_map(schemas, fields, alias_rows(spark, sf)).select(F.col("schema_name").alias("map_id"), "envelope")
    no_fields, no_aliases = spark.createDataFrame([], dictionary.FIELDS), spark.createDataFrame([], dictionary.ALIASES)
    got_fields, got_aliases, _ = dictionary.import_master_map(no_fields, no_aliases, "target", maps, at)
    counted = got_aliases.groupBy("field_id").agg(F.count("*").alias("n_aliases"))
    source = fields.filter("removed_at is null").select("name", F.col("schema_id").alias("from_brand"))
    return got_fields.join(counted, "field_id", "left").join(source, "name").select("from_brand", "name", F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"))
