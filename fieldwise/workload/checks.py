"""Mapping, validation, assembly and audit over orders and customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Field, FieldSet, Tables
from ..operators import convert, dictionary, validate
from ..operators.evidence import annotate_locales
from ..operators.matching import alias_index, field_set_signature, prefill, resolve_mappings, targets_for
from ..plans import pipeline
from ..plans.learning import learn
from ..sinks import export
from ..sources.frames import from_dataframe
from .registry import comma_money, query, sql_comma_money, sql_values, table

ORDER_FIELDS = FieldSet("orders", (
    Field("order_id", "integer"), Field("status", "text", allowed_values=("F", "O")), Field("priority", "text"),
    Field("total", "number", min=0.0), Field("order_date", "date", date_format="%Y-%m-%d"),
))
CUSTOMER_FIELDS = FieldSet("customers", (
    Field("customer_id", "integer"), Field("name", "text"), Field("segment", "text"), Field("balance", "number"), Field("phone", "text", required=False),
))
ALIASES = [
    ("orders", "order_id", "o_orderkey"), ("orders", "status", "o_orderstatus"), ("orders", "priority", "o_orderpriority"),
    ("orders", "total", "o_totalprice"), ("orders", "order_date", "o_orderdate"),
    ("customers", "customer_id", "c_custkey"), ("customers", "name", "C_Name"), ("customers", "segment", "c_mktsegment"), ("customers", "balance", "c_acctbal"),
]


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "schema_name string, field_name string, source_column string")


def orders_corpus(spark: SparkSession, sf: str) -> Tables:
    orders = table(spark, sf, "orders")
    return from_dataframe(orders, "orders.csv", F.col("o_orderkey"), {
        "o_orderkey": F.col("o_orderkey"), "o_custkey": F.col("o_custkey"), "o_orderstatus": F.col("o_orderstatus"),
        "o_totalprice": comma_money(F.col("o_totalprice")), "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority": F.col("o_orderpriority"),
    })


def customer_corpus(spark: SparkSession, sf: str) -> Tables:
    customer = table(spark, sf, "customer")
    return from_dataframe(customer, "customer.csv", F.col("c_custkey"), {
        "c_custkey": F.col("c_custkey"), "c_name": F.col("c_name"), "c_mktsegment": F.col("c_mktsegment"), "c_acctbal": comma_money(F.col("c_acctbal")),
    })


SQL_REPORT = f"""
  with o as (select count(*) as n, count(*) filter (o_orderstatus not in ('F','O')) as bad from orders), c as (select count(*) as n from customer)
  select 'orders.csv' as dataset, t.target_field, t.source_column, t.locale, n as rows, n as converted, case when t.target_field='status' then bad else 0 end as violations,
    t.target_field='status' and bad>0 as needs_confirmation, bad=0 as ready
  from o, {sql_values([('order_id', 'o_orderkey', 'decimal_point'), ('status', 'o_orderstatus', 'non_numeric'), ('priority', 'o_orderpriority', 'non_numeric'), ('total', 'o_totalprice', 'decimal_comma'), ('order_date', 'o_orderdate', 'non_numeric')], ['target_field', 'source_column', 'locale'])}
  union all
  select 'customer.csv', t.target_field, t.source_column, t.locale, case when t.source_column is null then 0 else n end, case when t.source_column is null then 0 else n end, 0, false, true
  from c, {sql_values([('customer_id', 'c_custkey', 'decimal_point'), ('name', 'c_name', 'non_numeric'), ('segment', 'c_mktsegment', 'non_numeric'), ('balance', 'c_acctbal', 'decimal_comma'), ('phone', None, 'decimal_point')], ['target_field', 'source_column', 'locale'])}"""


@query("readiness_report", SQL_REPORT)
def readiness_report(spark: SparkSession, sf: str) -> DataFrame:
    """Map orders and customer through their aliases, convert and check every value, and say what may leave."""
    parts = []
    for corpus, fields in ((orders_corpus(spark, sf), ORDER_FIELDS), (customer_corpus(spark, sf), CUSTOMER_FIELDS)):
        known = aliases(spark).filter(F.col("schema_name") == fields.name)
        review = pipeline.map_corpus(corpus, fields, known)
        parts.append(pipeline.field_report(review, corpus, fields))
    return parts[0].unionByName(parts[1])


# ---- many datasets of one schema: one per (status, priority) ----------------------------------

SPLIT_HEADERS = ["key", "priority", "total", "balance", "note"]
SPLIT_FIELDS = FieldSet("split", (
    Field("key", "integer"), Field("priority", "text", allowed_values=("1-urgent", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")),
    Field("total", "number", min=1000.0, max=450000.0), Field("balance", "number", min=0.0), Field("note", "text", unit="kg"), Field("lab", "text", allowed_values=("north", "south")),
    Field("free"),
))


def split_corpus(spark: SparkSession, sf: str) -> Tables:
    """One dataset per order priority; balance carries the customer key as a signed amount."""
    orders = table(spark, sf, "orders")
    rows = orders.select(
        F.col("o_orderpriority").alias("dataset_id"), F.col("o_orderkey").alias("row_idx"),
        F.array(
            F.col("o_orderkey").cast("string"), F.when(F.col("o_custkey") % 97 == 0, " ").otherwise(F.col("o_orderpriority")), comma_money(F.col("o_totalprice")),
            (F.col("o_custkey") - 5).cast("string"), F.when(F.col("o_orderstatus") == "P", "g").otherwise(" kg "),
        ).alias("cells"),
    )
    ids = rows.select("dataset_id").distinct()
    columns = ids.select("dataset_id", F.posexplode(F.array(*[F.lit(h) for h in SPLIT_HEADERS])).alias("col_idx", "header"))
    datasets = ids.select("dataset_id", F.concat("dataset_id", F.lit(".csv")).alias("source_file"), F.col("dataset_id").alias("sheet"), F.lit(0).alias("table_idx"), F.col("dataset_id").alias("origin_sheet"), F.lit(None).cast("string").alias("label"))
    return Tables(datasets, columns, rows)


def split_mappings(corpus: Tables) -> DataFrame:
    """Every field on its own column; `lab` inferred, `free` absent, `total` with a ranked alternative."""
    ids = corpus.datasets.select("dataset_id")
    fields = F.array(*[F.lit(n) for n in SPLIT_FIELDS.names])
    entry = ids.select("dataset_id", F.explode(fields).alias("target_field"))
    alternatives = F.when(
        F.col("target_field") == "total", F.array(F.struct(F.lit("balance").alias("source_column"), F.lit(0.4).alias("confidence")))
    ).otherwise(F.array().cast("array<struct<source_column:string,confidence:double>>"))
    return entry.select(
        "dataset_id", "target_field", F.when(F.col("target_field").isin(*SPLIT_HEADERS), F.col("target_field")).alias("source_column"),
        F.lit(0.9).alias("confidence"), F.lit("given").alias("reasoning"), F.lit(False).alias("needs_confirmation"),
        F.when(F.col("target_field") == "lab", F.when(F.col("dataset_id") == "2-HIGH", "east").otherwise("North")).alias("inferred_value"), alternatives.alias("alternatives"),
    )


SQL_SPLIT = f"""rowsx as (select o_orderpriority as dataset_id, o_orderkey as row_idx, case when o_custkey%97=0 then ' ' else o_orderpriority end as pri, o_totalprice as total, {sql_comma_money('o_totalprice')} as total_text,
   o_custkey-5 as balance, case when o_orderstatus='P' then 'g' else ' kg ' end as note from orders)"""
_FIRST = """firsts as (
  select dataset_id, 'priority' as target_field, 0 as rank, 'priority' as source_column, min(row_idx) as row_idx,
    arg_min(case when trim(pri)='' then ''''||pri||''' is blank in a required field' else ''''||pri||''' is outside the allowed values (1-urgent, 2-HIGH, 3-MEDIUM, 4-NOT SPECIFIED)' end, row_idx) as message, count(*) as n_violations
  from rowsx where lower(trim(pri)) not in ('1-urgent','2-high','3-medium','4-not specified') group by dataset_id
  union all select dataset_id, 'total', 0, 'total', min(row_idx), arg_min(case when total<1000 then cast(total as varchar)||' is below the minimum 1000.0' else cast(total as varchar)||' is above the maximum 450000.0' end, row_idx), count(*) from rowsx where total<1000 or total>450000 group by dataset_id
  union all select dataset_id, 'total', 1, 'balance', min(row_idx), arg_min(case when balance<1000 then cast(cast(balance as double) as varchar)||' is below the minimum 1000.0' else cast(cast(balance as double) as varchar)||' is above the maximum 450000.0' end, row_idx), count(*) from rowsx where balance<1000 or balance>450000 group by dataset_id
  union all select dataset_id, 'balance', 0, 'balance', min(row_idx), arg_min(cast(cast(balance as double) as varchar)||' is below the minimum 0.0', row_idx), count(*) from rowsx where balance<0 group by dataset_id)"""


@query("first_violations", f"with {SQL_SPLIT}, {_FIRST} select * from firsts")
def first_violations(spark: SparkSession, sf: str) -> DataFrame:
    corpus = split_corpus(spark, sf)
    columns = annotate_locales(corpus.columns, corpus.rows)
    fields = SPLIT_FIELDS.frame(spark)
    mappings = split_mappings(corpus)
    picked = validate.candidates(mappings)
    checks = convert.bind(mappings.drop("source_column").join(picked, ["dataset_id", "target_field"]), columns, fields)
    return validate.first_violations(corpus.rows, checks.filter(F.col("col_idx").isNotNull()))


SQL_NOTES = f"""with {SQL_SPLIT}, {_FIRST},
  ids as (select distinct dataset_id from rowsx), f as (select unnest(['key','priority','total','balance','note','lab','free']) as target_field),
  flagged as (select distinct dataset_id, 'note' as target_field from rowsx where trim(note)<>'kg'),
  notes as (select dataset_id, target_field, string_agg('column '''||source_column||''': '||message, '; ' order by rank) as cn from firsts group by all)"""
_NOTE = """nullif(concat_ws('; ', case when fl.target_field is not null then 'a value failed its number, date or unit conversion' end, n.cn,
  case when f.target_field='lab' and ids.dataset_id='2-HIGH' then 'inferred value: ''east'' is outside the allowed values (north, south)' end), '')"""


@query(
    "validate_notes",
    f"""{SQL_NOTES} select ids.dataset_id, f.target_field, case when f.target_field='free' then 'no constraints declared for this field' else coalesce({_NOTE}, 'no violation found') end as validator_note,
      {_NOTE} is not null as needs_confirmation from ids cross join f left join flagged fl on fl.dataset_id=ids.dataset_id and fl.target_field=f.target_field left join notes n on n.dataset_id=ids.dataset_id and n.target_field=f.target_field""",
)
def validate_notes(spark: SparkSession, sf: str) -> DataFrame:
    corpus = split_corpus(spark, sf)
    columns = annotate_locales(corpus.columns, corpus.rows)
    checked = validate.validate(split_mappings(corpus), columns, corpus.rows, SPLIT_FIELDS.frame(spark))
    return checked.select("dataset_id", "target_field", "validator_note", "needs_confirmation")


@query(
    "readiness_gate",
    f"""{SQL_NOTES} select ids.dataset_id, bool_and({_NOTE} is null) as ready, array_to_string(list_sort(list(f.target_field) filter ({_NOTE} is not null)), ',') as unclear
      from ids cross join f left join flagged fl on fl.dataset_id=ids.dataset_id and fl.target_field=f.target_field left join notes n on n.dataset_id=ids.dataset_id and n.target_field=f.target_field group by ids.dataset_id""",
)
def readiness_gate(spark: SparkSession, sf: str) -> DataFrame:
    corpus = split_corpus(spark, sf)
    columns = annotate_locales(corpus.columns, corpus.rows)
    checked = validate.validate(split_mappings(corpus), columns, corpus.rows, SPLIT_FIELDS.frame(spark))
    return validate.readiness(checked, corpus.datasets).select("dataset_id", "ready", F.array_join("unclear_fields", ",").alias("unclear"))


@query(
    "violations_lenient",
    f"""with all_rows as (select *, row_number() over (partition by o_orderpriority order by o_orderkey) as rn from orders), {SQL_SPLIT.replace('from orders', 'from all_rows where rn<=6')}, {_FIRST}
      select dataset_id, target_field, rank, source_column, row_idx, message, n_violations from firsts""",
)
def violations_lenient(spark: SparkSession, sf: str) -> DataFrame:
    """Lenient strictness reads the first six rows of every dataset."""
    corpus = split_corpus(spark, sf)
    columns = annotate_locales(corpus.columns, corpus.rows)
    mappings = split_mappings(corpus)
    checks = convert.bind(mappings.drop("source_column").join(validate.candidates(mappings), ["dataset_id", "target_field"]), columns, SPLIT_FIELDS.frame(spark))
    return validate.first_violations(validate.first_rows(corpus.rows, 6), checks.filter(F.col("col_idx").isNotNull()))


@query(
    "assemble_records",
    f"""with {SQL_SPLIT} select dataset_id, row_idx, row_idx as "key", pri as priority, total, cast(balance as double) as balance, note, case when dataset_id='2-HIGH' then 'east' else 'North' end as lab, cast(null as varchar) as free,
      case when trim(note)<>'kg' then 'note' else '' end as flags, dataset_id as __source_sheet from rowsx""",
)
def assemble_records(spark: SparkSession, sf: str) -> DataFrame:
    corpus = split_corpus(spark, sf)
    columns = annotate_locales(corpus.columns, corpus.rows)
    bound = convert.bind(split_mappings(corpus), columns, SPLIT_FIELDS.frame(spark))
    tidy = convert.assemble(corpus.rows, bound, SPLIT_FIELDS, corpus.datasets)
    return tidy.withColumn("flags", F.array_join("__flags", ",")).drop("__flags", "__raw")


@query("flagged_fields", f"with {SQL_SPLIT} select dataset_id, 'note' as target_field, count(*) as n_flagged from rowsx where trim(note)<>'kg' group by dataset_id")
def flagged_fields(spark: SparkSession, sf: str) -> DataFrame:
    corpus = split_corpus(spark, sf)
    columns = annotate_locales(corpus.columns, corpus.rows)
    bound = convert.bind(split_mappings(corpus), columns, SPLIT_FIELDS.frame(spark))
    return convert.flagged_fields(convert.assemble(corpus.rows, bound, SPLIT_FIELDS))


@query("assemble_wide", "select o_orderkey as order_id, o_orderstatus as status, o_orderpriority as priority, o_totalprice as total, cast(o_orderdate as date) as order_date, '' as flags from orders")
def assemble_wide(spark: SparkSession, sf: str) -> DataFrame:
    """One settled layout over one large table: a projection, no join and no shuffle."""
    orders = table(spark, sf, "orders")
    spots = {
        "order_id": F.col("o_orderkey"), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"),
        "total": comma_money(F.col("o_totalprice")), "order_date": F.date_format("o_orderdate", "yyyy-MM-dd"),
    }
    tidy = convert.assemble_wide(orders, spots, {"order_id": "decimal_point", "total": "decimal_comma"}, ORDER_FIELDS)
    return tidy.withColumn("flags", F.array_join("__flags", ",")).drop("__flags")


@query(
    "field_coverage",
    """with m as (select 'order-'||cast(o_orderkey as varchar) as dataset_id, o_orderstatus as status from orders),
      have as (select dataset_id, unnest(case status when 'F' then ['key','total'] when 'O' then ['key','extra'] else ['key','total','note'] end) as target_field from m),
      want as (select dataset_id, unnest(['key','total','note']) as target_field from m)
      select dataset_id, target_field, 'missing' as problem from (select * from want except select * from have)
      union all select dataset_id, target_field, 'unknown' from (select * from have except select * from want)""",
)
def field_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """A mapping per order: which declared fields are missing, which mapped ones are unknown."""
    names = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("key"), F.lit("total"))).when(
        F.col("o_orderstatus") == "O", F.array(F.lit("key"), F.lit("extra"))
    ).otherwise(F.array(F.lit("key"), F.lit("total"), F.lit("note")))
    mappings = table(spark, sf, "orders").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("dataset_id"), F.explode(names).alias("target_field"))
    return validate.check_coverage(mappings, ["key", "total", "note"])


@query(
    "field_declarations",
    """with d as (select p_brand as schema_name, case p_partkey%6 when 0 then p_name when 1 then '' when 2 then '--' when 3 then repeat(p_name,9) when 4 then 'a'||chr(10)||p_name else '  '||p_name end as name,
        case when p_size%10=0 then 'money' when p_size%2=0 then 'number' end as type from part)
      select * from (select schema_name, name, case when name='' then 'a field needs a name' when not regexp_matches(trim(name),'[a-zA-Z0-9]') then 'the name has no letter or digit' when length(trim(name))>64 then 'the name is longer than 64 characters'
        when contains(trim(name), chr(10)) then 'the name holds a line break or control character' when type='money' then 'unknown field type' end as error from d) where error is not null
      union all select schema_name, null, 'more than 50 fields' from d group by schema_name having count(*)>50""",
)
def field_declarations(spark: SparkSession, sf: str) -> DataFrame:
    """Every part as a field declaration of its brand, some of them unusable."""
    kind = F.col("p_partkey") % 6
    name = (
        F.when(kind == 0, F.col("p_name")).when(kind == 1, "").when(kind == 2, "--").when(kind == 3, F.repeat("p_name", 9))
        .when(kind == 4, F.concat(F.lit("a\n"), F.col("p_name"))).otherwise(F.concat(F.lit("  "), F.col("p_name")))
    )
    typed = F.when(F.col("p_size") % 10 == 0, "money").when(F.col("p_size") % 2 == 0, "number")
    return validate.check_fields(table(spark, sf, "part").select(F.col("p_brand").alias("schema_name"), name.alias("name"), typed.alias("type")))


@query(
    "schema_drift",
    """with s as (select 'customer-'||cast(c_custkey as varchar) as dataset_id, c_mktsegment as schema_name, case when c_nationkey%4=0 then 'old' else 'sig-'||c_mktsegment end as field_set_signature from customer)
      select dataset_id, schema_name, field_set_signature, 'sig-'||schema_name as current_signature from s where field_set_signature='old'""",
)
def schema_drift(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    current = F.concat(F.lit("sig-"), F.col("c_mktsegment"))
    recorded = customer.select(
        F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("dataset_id"), F.col("c_mktsegment").alias("schema_name"),
        F.when(F.col("c_nationkey") % 4 == 0, "old").otherwise(current).alias("field_set_signature"),
    )
    return validate.check_drift(recorded, customer.select(F.col("c_mktsegment").alias("schema_name"), current.alias("signature")).distinct())


@query(
    "run_report",
    """with n as (select c_custkey, count(o_orderkey) as n_rows from customer left join orders on o_custkey=c_custkey group by c_custkey)
      select 'customer-'||cast(n.c_custkey as varchar) as dataset_id, n_rows, case when n_rows=0 then 'empty' when c.c_acctbal>=0 then 'exported' else 'not_ready' end as status from n join customer c on c.c_custkey=n.c_custkey""",
)
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    """A dataset per customer with its orders as rows; customers without orders are reported, not mapped."""
    ident = lambda c: F.concat(F.lit("customer-"), F.col(c).cast("string")).alias("dataset_id")
    customer = table(spark, sf, "customer")
    report, _ = validate.run_report(
        customer.select(ident("c_custkey")), table(spark, sf, "orders").select(ident("o_custkey")), customer.select(ident("c_custkey"), (F.col("c_acctbal") >= 0).alias("ready"))
    )
    return report


def _crosswalk(spark: SparkSession, sf: str):
    corpus = customer_corpus(spark, sf)
    fields = CUSTOMER_FIELDS.frame(spark)
    datasets = corpus.datasets.withColumn("schema_name", F.lit("customers"))
    index = alias_index(fields, aliases(spark).filter("schema_name = 'customers'"))
    return corpus, fields, targets_for(datasets, fields), index


def supplier_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A dataset per supplier, each naming four of six columns, spelled its own way."""
    kind = F.col("s_suppkey") % 4
    names = (
        F.when(kind == 0, F.array(*[F.lit(x) for x in ("C_CustKey", "c_name", "extra", "")]))
        .when(kind == 1, F.array(*[F.lit(x) for x in (" c_name ", "customer  id", "c_acctbal", "c_acctbal")]))
        .when(kind == 2, F.array(*[F.lit(x) for x in ("segment", "Phone", "NAME", "c_name")]))
        .otherwise(F.array(*[F.lit(x) for x in ("nothing", "known", "here", "ID")]))
    )
    return table(spark, sf, "supplier").select(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("dataset_id"), F.posexplode(names).alias("col_idx", "header"))


SQL_SUPPLIER_COLUMNS = """sc as (select 'supplier-'||cast(s_suppkey as varchar) as dataset_id, unnest([0,1,2,3]) as col_idx,
   unnest(case s_suppkey%4 when 0 then ['C_CustKey','c_name','extra',''] when 1 then [' c_name ','customer  id','c_acctbal','c_acctbal'] when 2 then ['segment','Phone','NAME','c_name'] else ['nothing','known','here','ID'] end) as header from supplier)"""
SQL_INDEX = f"""idx as (select norm, case when count(distinct field)=1 then min(field) end as field from (
   select lower(trim(regexp_replace(s,'\\s+',' ','g'))) as norm, field from {sql_values([(f.name, f.name) for f in CUSTOMER_FIELDS.fields] + [(f.name.replace('_', ' '), f.name) for f in CUSTOMER_FIELDS.fields] + [(s, f) for n, f, s in ALIASES if n == 'customers'], ['s', 'field'])}) group by norm)"""
SQL_COVERED = f"""{SQL_SUPPLIER_COLUMNS}, {SQL_INDEX}, cov as (select dataset_id, field, arg_min(header,col_idx) as header from sc join idx on idx.norm=lower(trim(regexp_replace(header,'\\s+',' ','g'))) where field is not null group by all)"""


@query(
    "crosswalk_prefill",
    f"with {SQL_COVERED} select dataset_id, field as target_field, header as source_column, 1.0::double as confidence, 'crosswalk alias '''||header||'''' as reasoning, false as needs_confirmation from cov",
)
def crosswalk_prefill(spark: SparkSession, sf: str) -> DataFrame:
    columns = supplier_columns(spark, sf)
    fields = CUSTOMER_FIELDS.frame(spark)
    datasets = columns.select("dataset_id").distinct().withColumn("schema_name", F.lit("customers"))
    mappings, _ = prefill(columns, targets_for(datasets, fields), alias_index(fields, aliases(spark).filter("schema_name = 'customers'")))
    return mappings.drop("inferred_value", "alternatives")


_F5 = sql_values([(f.name, f.required) for f in CUSTOMER_FIELDS.fields], ["field", "required"])


@query(
    "layered_mapping",
    f"""with {SQL_COVERED}, want as (select distinct sc.dataset_id, t.field, t.required from sc, {_F5}),
      ans as (select dataset_id, 'balance' as field, case when dataset_id like '%1' then 'no such column' else '' end as source_column, 0.5 as confidence from (select distinct dataset_id from sc))
      select w.dataset_id, w.field as target_field, case when c.field is not null then c.header else a.source_column end as source_column,
        case when c.field is not null then 1.0 when a.field is not null then 0.5 else 0.0 end::double as confidence,
        case when c.field is not null then false when a.field is not null then not exists (select 1 from sc where sc.dataset_id=w.dataset_id and sc.header=a.source_column) else w.required end as needs_confirmation
      from want w left join cov c on c.dataset_id=w.dataset_id and c.field=w.field left join ans a on a.dataset_id=w.dataset_id and a.field=w.field""",
)
def layered_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Crosswalk first, a proposer for the rest, closures over its answers."""
    columns = supplier_columns(spark, sf)
    fields = CUSTOMER_FIELDS.frame(spark)
    datasets = columns.select("dataset_id").distinct().withColumn("schema_name", F.lit("customers"))
    index = alias_index(fields, aliases(spark).filter("schema_name = 'customers'"))
    mappings, _ = resolve_mappings(columns, targets_for(datasets, fields), index, proposer=propose_balance)
    return mappings.select("dataset_id", "target_field", "source_column", "confidence", "needs_confirmation")


def propose_balance(uncovered: DataFrame) -> DataFrame:
    """A stand-in proposer: it answers for one field, sometimes with a column that is not there."""
    return uncovered.filter(F.col("target_field") == "balance").select(
        "dataset_id", "target_field", F.when(F.col("dataset_id").endswith("1"), "no such column").otherwise("").alias("source_column"), F.lit(0.5).alias("confidence"),
        F.lit("guess").alias("reasoning"), F.lit(False).alias("needs_confirmation"), F.lit(None).cast("string").alias("inferred_value"),
        F.array().cast("array<struct<source_column:string,confidence:double>>").alias("alternatives"),
    )


@query(
    "escalation_counts",
    f"with {SQL_COVERED} select s.dataset_id, count(cov.field) as python_matched, 5-count(cov.field) as escalated, 5 as total from (select distinct dataset_id from sc) s left join cov on cov.dataset_id=s.dataset_id group by s.dataset_id",
)
def escalation_counts(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.matching import escalation

    columns = supplier_columns(spark, sf)
    fields = CUSTOMER_FIELDS.frame(spark)
    datasets = columns.select("dataset_id").distinct().withColumn("schema_name", F.lit("customers"))
    index = alias_index(fields, aliases(spark).filter("schema_name = 'customers'"))
    _, provenance = resolve_mappings(columns, targets_for(datasets, fields), index)
    return escalation(provenance)


@query("absent_fields", f"with {SQL_COVERED}, want as (select distinct sc.dataset_id, t.field from sc, {_F5}) select dataset_id, field as target_field from want except select dataset_id, field from cov")
def absent_fields(spark: SparkSession, sf: str) -> DataFrame:
    return export.absent_fields(_supplier_mappings(spark, sf)[1])


@query("unclaimed_columns", f"with {SQL_COVERED} select dataset_id, col_idx, header from sc where trim(header)<>'' and not exists (select 1 from cov where cov.dataset_id=sc.dataset_id and cov.header=sc.header)")
def unclaimed_columns(spark: SparkSession, sf: str) -> DataFrame:
    columns, mappings = _supplier_mappings(spark, sf)
    return export.unclaimed_columns(columns, mappings)


def _supplier_mappings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    columns = supplier_columns(spark, sf)
    fields = CUSTOMER_FIELDS.frame(spark)
    datasets = columns.select("dataset_id").distinct().withColumn("schema_name", F.lit("customers"))
    index = alias_index(fields, aliases(spark).filter("schema_name = 'customers'"))
    mappings, _ = resolve_mappings(columns, targets_for(datasets, fields), index)
    return columns, mappings


@query(
    "audit_manifests",
    f"""with {SQL_COVERED}, want as (select distinct sc.dataset_id, t.field from sc, {_F5}),
      maps as (select w.dataset_id, w.field, c.header from want w left join cov c using (dataset_id, field))
      select m.dataset_id, 'file-'||m.dataset_id as source_file, array_to_string(list_sort(list(m.field||'='||case when m.header is null then 'absent' else 'column' end)), ',') as mapped,
        array_to_string(list_sort(list(m.field) filter (m.header is null)), ',') as absent,
        (select array_to_string(list(sc.header order by sc.col_idx), ',') from sc where sc.dataset_id=m.dataset_id and trim(header)<>'' and not exists (select 1 from cov where cov.dataset_id=sc.dataset_id and cov.header=sc.header)) as unclaimed,
        (select array_to_string(list(sc.header order by sc.col_idx), ',') from sc where sc.dataset_id=m.dataset_id) as headers
      from maps m group by m.dataset_id""",
)
def audit_manifests(spark: SparkSession, sf: str) -> DataFrame:
    columns, mappings = _supplier_mappings(spark, sf)
    ids = columns.select("dataset_id").distinct()
    datasets = ids.select("dataset_id", F.concat(F.lit("file-"), F.col("dataset_id")).alias("source_file"), F.col("dataset_id").alias("origin_sheet"))
    audit = ids.select("dataset_id", F.lit("customers").alias("schema_name"), F.lit("audit").alias("provenance"))
    entry = lambda m: F.concat(m["target_field"], F.lit("="), m["value_source"])
    return export.manifests(datasets, columns, mappings, audit).select(
        "dataset_id", "source_file", F.array_join(F.transform("field_mappings", entry), ",").alias("mapped"),
        F.array_join("fields_absent_from_source", ",").alias("absent"),
        F.when(F.size("columns_not_in_schema") > 0, F.array_join("columns_not_in_schema", ",")).alias("unclaimed"), F.array_join("source_columns", ",").alias("headers"),
    )


@query(
    "field_set_signature",
    """with f as (select p_brand as schema_name, p_name, p_type, p_size, p_partkey from part),
      j as (select schema_name, '{"name":"'||lower(p_name)||'","type":"number","unit":"'||p_type||'","allowed_values":null,"required":'||case when p_partkey%2=0 then 'true' else 'false' end||',"min":'||cast(cast(p_size as double) as varchar)||',"max":null,"date_format":null}' as one from f)
      select schema_name, sha256('['||array_to_string(list_transform(list_sort(list(one)), lambda x: '"'||replace(x,'"','\\"')||'"'),',')||']') as signature from j group by schema_name""",
)
def field_set_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as declared fields, signed per brand."""
    part = table(spark, sf, "part")
    none = F.lit(None).cast("string")
    fields = part.select(
        F.col("p_brand").alias("schema_name"), F.col("p_name").alias("name"), F.lit("number").alias("type"), F.col("p_type").alias("unit"),
        F.lit(None).cast("array<string>").alias("allowed_values"), (F.col("p_partkey") % 2 == 0).alias("required"), F.col("p_size").cast("double").alias("min"),
        F.lit(None).cast("double").alias("max"), none.alias("date_format"),
    )
    return field_set_signature(fields)


# ---- flags from outside, lenient reading, the gate, and a map file --------------------------------


@query(
    "contradicted_fields",
    """with ids as (select distinct o_orderpriority as dataset_id from orders), f as (select unnest(['order_id','order_date']) as target_field)
      select dataset_id, target_field, target_field='order_date' and dataset_id<'3' as needs_confirmation,
        case when target_field='order_date' and dataset_id<'3' then 'declared format %Y-%m-%d disagrees with values such as ''01/02/2024''' else 'no violation found' end as validator_note from ids cross join f""",
)
def contradicted_fields(spark: SparkSession, sf: str) -> DataFrame:
    """A declared date format that a column's values contradict raises the field's flag, though every value converts."""
    fields = FieldSet("dated", (Field("order_id", "integer"), Field("order_date", "date", date_format="%Y-%m-%d")))
    orders = table(spark, sf, "orders")
    rows = orders.select(
        F.col("o_orderpriority").alias("dataset_id"), F.col("o_orderkey").alias("row_idx"), F.array(F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("cells")
    )
    ids = rows.select("dataset_id").distinct()
    columns = ids.select("dataset_id", F.posexplode(F.array(*map(F.lit, fields.names))).alias("col_idx", "header"))
    mappings = ids.select("dataset_id", F.explode(F.array(*map(F.lit, fields.names))).alias("target_field")).select(
        "dataset_id", "target_field", F.col("target_field").alias("source_column"), F.lit(0.9).alias("confidence"), F.lit("given").alias("reasoning"), F.lit(False).alias("needs_confirmation"),
        F.lit(None).cast("string").alias("inferred_value"), F.array().cast("array<struct<source_column:string,confidence:double>>").alias("alternatives"),
    )
    told = ids.filter("dataset_id < '3'").select("dataset_id", F.lit("order_date").alias("target_field"), F.lit("%Y-%m-%d").alias("declared_format"), F.lit("01/02/2024").alias("example_value"))
    checked = validate.validate(mappings, annotate_locales(columns, rows), rows, fields.frame(spark), None, told)
    return checked.select("dataset_id", "target_field", "needs_confirmation", "validator_note")


@query(
    "notes_lenient",
    f"""{SQL_NOTES.replace('from orders)', 'from orders), lines as (select *, row_number() over (partition by dataset_id order by row_idx) as rn from rowsx)', 1).replace(_FIRST, _FIRST.replace('from rowsx', 'from lines').replace('where lower', 'where rn<=6 and lower').replace('where total<1000 or total>450000', 'where rn<=6 and (total<1000 or total>450000)').replace('where balance<1000 or balance>450000', 'where rn<=6 and (balance<1000 or balance>450000)').replace('where balance<0', 'where rn<=6 and balance<0'))}
      select ids.dataset_id, f.target_field, case when f.target_field='free' then 'no constraints declared for this field' else coalesce({_NOTE}, 'no violation found') end as validator_note,
      {_NOTE} is not null as needs_confirmation from ids cross join f left join flagged fl on fl.dataset_id=ids.dataset_id and fl.target_field=f.target_field left join notes n on n.dataset_id=ids.dataset_id and n.target_field=f.target_field""",
)
def notes_lenient(spark: SparkSession, sf: str) -> DataFrame:
    """Lenient strictness: constraints from the first six rows of each dataset, conversions from all."""
    corpus = split_corpus(spark, sf)
    columns = annotate_locales(corpus.columns, corpus.rows)
    checked = validate.validate(split_mappings(corpus), columns, corpus.rows, SPLIT_FIELDS.frame(spark), strictness="lenient")
    return checked.select("dataset_id", "target_field", "validator_note", "needs_confirmation")


GATE_FIELDS = FieldSet("gate", (Field("key", "integer"), Field("segment", "text", allowed_values=("Automobile", "building µ", "Furniture", "household", "Machinery")), Field("balance", "number")))


@query(
    "confirm_gate",
    """with c as (select 'nation-'||cast(c_nationkey as varchar) as dataset_id, c_custkey, c_mktsegment, c_acctbal, c_nationkey from customer)
      select dataset_id, 'tidy' as outcome, count(*) as n, cast(sum(round(c_acctbal*100)) as bigint) as cents from c where c_nationkey%5<>0 and c_nationkey%7<>0 group by 1
      union all select distinct dataset_id, case when c_nationkey%7=0 then 'missing field: balance' else 'needs confirmation: segment' end, 0, 0 from c where c_nationkey%5=0 or c_nationkey%7=0""",
)
def confirm_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of a nation as one dataset: some lack a mapping, some hold a segment that is not allowed, the rest become records.

    One allowed value is written with a micro sign, the cells with a mu.
    """
    customer = table(spark, sf, "customer")
    ident = F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string"))
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "BUILDING μ").otherwise(F.col("c_mktsegment"))
    off = (F.col("c_nationkey") % 5 == 0).alias("off")
    rows = customer.select(
        ident.alias("dataset_id"), F.col("c_custkey").alias("row_idx"),
        F.array(F.col("c_custkey").cast("string"), F.when(F.col("c_nationkey") % 5 == 0, "boats").otherwise(segment), comma_money(F.col("c_acctbal"))).alias("cells"),
    )
    ids = customer.select(ident.alias("dataset_id"), "c_nationkey", off).distinct()
    columns = ids.select("dataset_id", F.posexplode(F.array(F.lit("key"), F.lit("segment"), F.lit("balance"))).alias("col_idx", "header"))
    datasets = ids.select("dataset_id", F.concat("dataset_id", F.lit(".csv")).alias("source_file"), F.col("dataset_id").alias("sheet"), F.lit(0).alias("table_idx"), F.col("dataset_id").alias("origin_sheet"), F.lit(None).cast("string").alias("label"))
    names = F.when(F.col("c_nationkey") % 7 == 0, F.array(F.lit("key"), F.lit("segment"))).otherwise(F.array(F.lit("key"), F.lit("segment"), F.lit("balance")))
    edited = ids.select("dataset_id", F.explode(names).alias("target_field")).select(
        "dataset_id", "target_field", F.col("target_field").alias("source_column"), F.lit(0.9).alias("confidence"), F.lit("edited").alias("reasoning"), F.lit(False).alias("needs_confirmation"),
        F.lit(None).cast("string").alias("inferred_value"), F.array().cast("array<struct<source_column:string,confidence:double>>").alias("alternatives"),
    )
    done = pipeline.confirm(Tables(datasets, columns, rows), annotate_locales(columns, rows), edited, GATE_FIELDS, F.lit("2024-01-01 00:00:00"))
    cents = F.sum(F.round(F.col("balance") * 100)).cast("bigint")
    tidy = done.tidy.groupBy("dataset_id").agg(F.lit("tidy").alias("outcome"), F.count("*").alias("n"), cents.alias("cents"))
    return tidy.unionByName(done.rejected.select("dataset_id", F.col("reason").alias("outcome"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("cents")))


LOOP_FIELDS = FieldSet("loop", (Field("key", "integer"), Field("segment", "text"), Field("balance", "number")))


@query(
    "learning_loop",
    """select distinct 'nation-'||cast(c_nationkey as varchar) as dataset_id, 'proposer' as first_run, 'auto-applied-from-profile' as second_run, 0 as n_open, 3 as n_aliases from customer""",
)
def learning_loop(spark: SparkSession, sf: str) -> DataFrame:
    """Map with a proposer's help, confirm, save, and map again: the second run asks nothing."""
    customer = table(spark, sf, "customer")
    ident = F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string"))
    rows = customer.select(ident.alias("dataset_id"), F.col("c_custkey").alias("row_idx"), F.array(F.col("c_custkey").cast("string"), F.col("c_mktsegment"), comma_money(F.col("c_acctbal"))).alias("cells"))
    ids = customer.select(ident.alias("dataset_id"), "c_nationkey").distinct()
    odd = [F.lit("Nr"), F.concat(F.lit("Gruppe "), F.col("c_nationkey").cast("string")), F.lit("Saldo")]
    columns = ids.select("dataset_id", F.posexplode(F.array(*odd)).alias("col_idx", "header"))
    datasets = ids.select("dataset_id", F.concat("dataset_id", F.lit(".csv")).alias("source_file"), F.col("dataset_id").alias("sheet"), F.lit(0).alias("table_idx"), F.col("dataset_id").alias("origin_sheet"), F.lit(None).cast("string").alias("label"))
    corpus = Tables(datasets, columns, rows)

    def proposer(uncovered: DataFrame) -> DataFrame:
        place = F.when(F.col("target_field") == "key", 0).when(F.col("target_field") == "segment", 1).otherwise(2).alias("col_idx")
        return uncovered.select("dataset_id", "target_field", place).join(columns, ["dataset_id", "col_idx"]).select(
            "dataset_id", "target_field", F.col("header").alias("source_column"), F.lit(0.8).alias("confidence"), F.lit("looks like it").alias("reasoning"), F.lit(True).alias("needs_confirmation"),
            F.lit(None).cast("string").alias("inferred_value"), F.array().cast("array<struct<source_column:string,confidence:double>>").alias("alternatives"),
        )

    first = pipeline.map_corpus(corpus, LOOP_FIELDS, proposer=proposer)
    edited = first.mappings.withColumn("needs_confirmation", F.lit(False))
    done = pipeline.confirm(corpus, first.columns, edited, LOOP_FIELDS, F.lit("2024-01-01 00:00:00"))
    at, null = F.lit("2024-01-01").cast("timestamp"), F.lit(None).cast("string")
    declared = LOOP_FIELDS.frame(spark).select(
        F.concat(F.lit("f "), F.col("name")).alias("field_id"), F.lit("loop").alias("schema_id"), F.col("pos").cast("bigint").alias("seq"), "name", null.alias("description"), "type", "allowed_values",
        "unit", "required", "min", "max", "date_format", F.lit(None).cast("timestamp").alias("removed_at"), null.alias("removed_by"),
    )
    stored = spark.createDataFrame([], dictionary.PROFILES), spark.createDataFrame([], dictionary.ALIASES)
    learned = learn(corpus, done.mappings, LOOP_FIELDS, *stored, declared, ids.select("dataset_id", F.concat(F.lit("vendor "), F.col("dataset_id")).alias("vendor")), F.lit("user"), at)
    second = pipeline.map_corpus(corpus, LOOP_FIELDS, profiles=learned.profiles)
    still_open = second.mappings.groupBy("dataset_id").agg(F.count_if("needs_confirmation").cast("int").alias("n_open"))
    spelled = learned.aliases.groupBy(F.regexp_replace("vendor", "^vendor ", "").alias("dataset_id")).agg(F.count("*").cast("int").alias("n_aliases"))
    return (
        first.provenance.select("dataset_id", F.col("provenance").alias("first_run"))
        .join(second.provenance.select("dataset_id", F.col("provenance").alias("second_run")), "dataset_id")
        .join(still_open, "dataset_id").join(spelled, "dataset_id")
    )
