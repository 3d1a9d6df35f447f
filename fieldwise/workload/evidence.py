"""Column evidence and value conversion over orders, lineitem, conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..model import Field, FieldSet
from ..operators import convert, evidence
from ..operators.header import type_cells
from .registry import (
    comma_money, day, dot_money, pad2, query, sql_comma_money, sql_dot_money, table,
)

# ---- decimal locale ---------------------------------------------------------------------------

PRICE_HEADERS = ["price", "quantity", "flag", "grouped", "tax", "mixed"]


def price_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitem as one dataset per supplier, every cell text."""
    li = table(spark, sf, "lineitem")
    qty = F.col("l_quantity").cast("bigint")
    cells = F.array(
        comma_money(F.col("l_extendedprice")), qty.cast("string"), F.col("l_returnflag"),
        F.concat(qty.cast("string"), F.lit(","), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0")),
        dot_money(F.col("l_tax")),
        F.when(F.col("l_linenumber") % 2 == 0, dot_money(F.col("l_discount"))).otherwise(comma_money(F.col("l_discount"))),
    )
    return li.select(
        F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("dataset_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_idx"), cells.alias("cells"),
    )


SQL_PRICE_CELLS = f"""
  select 'supplier-'||cast(l_suppkey as varchar) as dataset_id, unnest([0,1,2,3,4,5]) as col_idx, unnest([
    {sql_comma_money('l_extendedprice')}, cast(cast(l_quantity as bigint) as varchar), l_returnflag,
    cast(cast(l_quantity as bigint) as varchar)||','||lpad(cast(l_partkey%1000 as varchar),3,'0'),
    {sql_dot_money('l_tax')},
    case when l_linenumber%2=0 then {sql_dot_money('l_discount')} else {sql_comma_money('l_discount')} end]) as v
  from lineitem"""

SQL_LOCALE = """case when not bool_or(regexp_full_match(v,'-?[0-9][0-9.]*,[0-9]+') or regexp_full_match(v,'-?[0-9]+\\.[0-9]+') or regexp_full_match(v,'-?[0-9]+')) then 'non_numeric'
    when bool_or(regexp_full_match(v,'-?[0-9][0-9.]*,[0-9]+')) and bool_or(regexp_full_match(v,'-?[0-9]+\\.[0-9]+')) then 'ambiguous'
    when bool_or(regexp_full_match(v,'-?[0-9][0-9.]*,[0-9]+')) and not bool_or(regexp_full_match(v,'-?[0-9][0-9.]*,[0-9]+') and not regexp_full_match(v,'-?[0-9][0-9.]*,[0-9][0-9][0-9]')) then 'ambiguous'
    when bool_or(regexp_full_match(v,'-?[0-9][0-9.]*,[0-9]+')) then 'decimal_comma' else 'decimal_point' end"""


@query("locale_classify", f"select dataset_id, col_idx, {SQL_LOCALE} as locale from ({SQL_PRICE_CELLS}) group by all")
def locale_classify(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.classify_locale(price_rows(spark, sf))


SQL_HEADER_NAME = "case col_idx " + " ".join(f"when {i} then '{h}'" for i, h in enumerate(PRICE_HEADERS)) + " end"


@query("locale_wide", f"select col_idx, {SQL_HEADER_NAME} as header, {SQL_LOCALE} as locale from ({SQL_PRICE_CELLS}) group by col_idx")
def locale_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The whole of lineitem as one wide table: a single aggregate without explode."""
    wide = price_rows(spark, sf).select(*[F.element_at("cells", i + 1).alias(h) for i, h in enumerate(PRICE_HEADERS)])
    return evidence.wide_locales(wide, PRICE_HEADERS)


@query(
    "locale_resolve",
    f"""with c as (select dataset_id, col_idx, {SQL_LOCALE} as locale from ({SQL_PRICE_CELLS}) group by all),
    a as (select distinct 'supplier-'||cast(s_suppkey as varchar) as dataset_id, case s_nationkey%3 when 0 then ',' when 1 then '.' end as answer from supplier)
    select c.dataset_id, col_idx, {SQL_HEADER_NAME} as header,
      case when locale='ambiguous' and answer=',' then 'decimal_comma' when locale='ambiguous' and answer='.' then 'decimal_point' else locale end as locale
    from c left join a on c.dataset_id=a.dataset_id""",
)
def locale_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of some nations answered the locale question, the others did not."""
    rows = price_rows(spark, sf)
    columns = rows.select("dataset_id").distinct().select(
        "dataset_id", F.posexplode(F.array(*[F.lit(h) for h in PRICE_HEADERS])).alias("col_idx", "header")
    )
    nation = F.col("s_nationkey") % 3
    hints = table(spark, sf, "supplier").select(
        F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("dataset_id"),
        F.when(nation == 0, ",").when(nation == 1, ".").alias("decimal_separator"),
    )
    resolved, _, _ = evidence.resolve_locales(evidence.annotate_locales(columns, rows), hints)
    return resolved


SQL_FLOAT = "(case when regexp_full_match(trim({0}),'[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(trim({0}) as double) end)"


def sql_comma_number(v: str) -> str:
    return SQL_FLOAT.format(f"replace(replace({v},'.',''),',','.')")


@query(
    "number_convert",
    f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey,
      {sql_comma_number(sql_comma_money('l_extendedprice'))} as price,
      {sql_comma_number(sql_comma_money('l_extendedprice'))} is null as price_flag,
      case when floor(l_quantity)=l_quantity then cast(l_quantity as bigint) end as quantity,
      case when {SQL_FLOAT.format(sql_dot_money('l_tax'))}=0 then cast(0 as bigint) end as whole_tax,
      {SQL_FLOAT.format(sql_dot_money('l_tax'))}<>0 as whole_tax_flag,
      cast(null as double) as text_number, true as text_flag
    from lineitem""",
)
def number_convert(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    comma, point, text = F.lit(numbers.DECIMAL_COMMA), F.lit(numbers.DECIMAL_POINT), F.lit(numbers.NON_NUMERIC)
    price, price_flag = convert.to_number(comma_money(F.col("l_extendedprice")), comma)
    quantity, _ = convert.to_integer(F.col("l_quantity").cast("bigint").cast("string"), point)
    whole, whole_flag = convert.to_integer(dot_money(F.col("l_tax")), point)
    word, word_flag = convert.to_number(F.col("l_returnflag"), text)
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price.alias("price"), price_flag.alias("price_flag"),
        quantity.alias("quantity"), whole.alias("whole_tax"), whole_flag.alias("whole_tax_flag"),
        word.alias("text_number"), word_flag.alias("text_flag"),
    )


# ---- date order -------------------------------------------------------------------------------

DATE_HEADERS = ["day_first", "month_first", "iso", "serial", "ambiguous", "both", "text", "compact", "timed", "short_ambiguous"]


def date_cells(source: str = "o_orderdate") -> list:
    d = F.col(source)
    dd, mm, yyyy = pad2(day(d)), pad2(F.month(d)), F.year(d).cast("string")
    low = ((day(d) - 1) % 12 + 1).cast("string")
    yy = pad2(F.year(d) % 100)
    slash, dash = F.lit("/"), F.lit("-")
    return [
        F.concat(dd, slash, mm, slash, yyyy),
        F.concat(mm, dash, dd, dash, yy),
        F.concat(yyyy, dash, mm, dash, dd),
        F.datediff(d.cast("date"), F.lit("1899-12-30").cast("date")).cast("string"),
        F.concat(low, slash, F.month(d).cast("string"), slash, yyyy),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(dd, slash, mm, slash, yyyy)).otherwise(F.concat(mm, slash, dd, slash, yyyy)),
        F.col("o_orderpriority"),
        F.concat(yyyy, mm, dd),
        F.concat(yyyy, slash, mm, slash, dd, F.lit(" 09:30")),
        F.concat(low, F.lit("."), mm, F.lit("."), yy),
    ]


def date_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.concat(F.col("o_orderstatus"), F.lit("/"), F.col("o_orderpriority")).alias("dataset_id"),
        F.col("o_orderkey").alias("row_idx"), F.array(*date_cells()).alias("cells"),
    )


_D, _M, _Y = "lpad(cast(day(o_orderdate) as varchar),2,'0')", "lpad(cast(month(o_orderdate) as varchar),2,'0')", "cast(year(o_orderdate) as varchar)"
_YY, _LOW = "lpad(cast(year(o_orderdate)%100 as varchar),2,'0')", "cast((day(o_orderdate)-1)%12+1 as varchar)"
SQL_DATE_LIST = [
    f"{_D}||'/'||{_M}||'/'||{_Y}", f"{_M}||'-'||{_D}||'-'||{_YY}", f"{_Y}||'-'||{_M}||'-'||{_D}",
    "cast(date_diff('day', date '1899-12-30', cast(o_orderdate as date)) as varchar)",
    f"{_LOW}||'/'||cast(month(o_orderdate) as varchar)||'/'||{_Y}",
    f"case when o_orderkey%2=0 then {_D}||'/'||{_M}||'/'||{_Y} else {_M}||'/'||{_D}||'/'||{_Y} end",
    "o_orderpriority", f"{_Y}||{_M}||{_D}", f"{_Y}||'/'||{_M}||'/'||{_D}||' 09:30'", f"{_LOW}||'.'||{_M}||'.'||{_YY}",
]
SQL_DATE_CELLS = f"""select o_orderstatus||'/'||o_orderpriority as dataset_id, o_orderkey as row_idx, unnest(range({len(SQL_DATE_LIST)})) as col_idx,
  unnest([{', '.join(SQL_DATE_LIST)}]) as v from orders"""

# Order evidence said in SQL: shapes by pattern, components by position, formats from the first value.
SQL_DATE_VERDICT = f"""
 cells as ({SQL_DATE_CELLS}),
 shaped as (select *, case
     when regexp_full_match(v,'[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}( [0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?)?|[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}( [0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?)?') then 'iso'
     when regexp_full_match(v,'[0-9]{{8}}') and try_cast(v[1:4] as int) between 1900 and 2100 then 'compact'
     when regexp_full_match(v,'[0-9]{{1,2}}/[0-9]{{1,2}}/([0-9]{{4}}|[0-9]{{2}})|[0-9]{{1,2}}-[0-9]{{1,2}}-([0-9]{{4}}|[0-9]{{2}})|[0-9]{{1,2}}\\.[0-9]{{1,2}}\\.([0-9]{{4}}|[0-9]{{2}})') then 'dm'
     when regexp_full_match(v,'[0-9]+') then 'int' end as shape from cells),
 parts as (select *, regexp_extract_all(v,'[0-9]+') as p, regexp_extract(v,'[^0-9]',0) as sep from shaped),
 fmts as (select *, case when shape='iso' then '%Y'||sep||'%m'||sep||'%d'||case len(p) when 5 then ' %H:%M' when 6 then ' %H:%M:%S' else '' end when shape='compact' then '%Y%m%d' end as iso_fmt,
   case when shape='dm' then '%d'||sep||'%m'||sep||case when len(p[3])=4 then '%Y' else '%y' end end as day_fmt,
   case when shape='dm' then '%m'||sep||'%d'||sep||case when len(p[3])=4 then '%Y' else '%y' end end as month_fmt,
   case when shape='dm' then case when len(p[3])=4 then p[3] when cast(p[3] as int)>=69 then '19'||p[3] else '20'||p[3] end end as yr from parts),
 ev as (select dataset_id, col_idx, count(*) as n_nonblank,
   count(*) filter (shape in ('iso','compact')) as n_iso, count(*) filter (shape='dm') as n_dm, count(*) filter (shape='int') as n_int,
   count(distinct iso_fmt) as n_iso_fmt, arg_min(iso_fmt,row_idx) as iso_fmt,
   bool_and(try_cast(case when shape='iso' then p[1]||'-'||p[2]||'-'||p[3] else v[1:4]||'-'||v[5:6]||'-'||v[7:8] end as date) is not null) filter (shape in ('iso','compact')) as iso_ok,
   count(distinct day_fmt) as n_dm_fmt, arg_min(day_fmt,row_idx) filter (shape='dm') as day_fmt, arg_min(month_fmt,row_idx) filter (shape='dm') as month_fmt,
   bool_or(try_cast(p[1] as bigint)>12) filter (shape='dm') as f12, bool_or(try_cast(p[2] as bigint)>12) filter (shape='dm') as s12,
   bool_and(try_cast(yr||'-'||p[2]||'-'||p[1] as date) is not null) filter (shape='dm') as day_ok,
   bool_and(try_cast(yr||'-'||p[1]||'-'||p[2] as date) is not null) filter (shape='dm') as month_ok,
   bool_and(try_cast(v as bigint) between 25569 and 73050) filter (shape='int') as serial_ok
   from fmts group by all),
 verdict as (select *, case when n_iso>0 then case when iso_ok and n_iso_fmt=1 then 'iso' else 'invalid' end
   when n_dm>0 then case when f12 and s12 then 'invalid' when f12 then case when day_ok and n_dm_fmt=1 then 'day_first' else 'invalid' end
     when s12 then case when month_ok and n_dm_fmt=1 then 'month_first' else 'invalid' end else 'ambiguous' end
   when n_int>0 and serial_ok then 'excel_serial' else 'non_date' end as ord from ev)"""

SQL_CHOSEN_FORMAT = "case ord when 'excel_serial' then 'excel_serial' when 'iso' then iso_fmt when 'day_first' then day_fmt when 'month_first' then month_fmt end"


@query(
    "date_order",
    f"""with {SQL_DATE_VERDICT} select dataset_id, col_idx, ord as "order", {SQL_CHOSEN_FORMAT} as date_format,
      case when ord='ambiguous' then day_fmt end as day_first_format, case when ord='ambiguous' then month_fmt end as month_first_format, n_nonblank from verdict""",
)
def date_order(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.classify_date_order(date_rows(spark, sf)).drop("day_first_fits", "month_first_fits")


@query(
    "date_order_wide",
    f"""with {SQL_DATE_VERDICT.replace("o_orderstatus||'/'||o_orderpriority as dataset_id", "'all' as dataset_id")}
      select col_idx, case col_idx {' '.join(f"when {i} then '{h}'" for i, h in enumerate(DATE_HEADERS))} end as header, ord as "order", {SQL_CHOSEN_FORMAT} as date_format,
      case when ord='ambiguous' then day_fmt end as day_first_format, case when ord='ambiguous' then month_fmt end as month_first_format from verdict""",
)
def date_order_wide(spark: SparkSession, sf: str) -> DataFrame:
    wide = table(spark, sf, "orders").select("o_orderkey", *[c.alias(h) for c, h in zip(date_cells(), DATE_HEADERS)])
    return evidence.wide_date_orders(wide, DATE_HEADERS, F.col("o_orderkey"))


@query(
    "date_implied_order",
    f"""with {SQL_DATE_VERDICT}, answered as (select dataset_id, col_idx, ord, day_fmt, month_fmt, case when dataset_id like 'F/%' then 'day_first' else 'month_first' end as answer from verdict)
      select dataset_id, col_idx, answer, case when ord='ambiguous' then case answer when 'day_first' then day_fmt else month_fmt end end as chosen,
      case when ord='ambiguous' then answer end as implied from answered""",
)
def date_implied_order(spark: SparkSession, sf: str) -> DataFrame:
    """An answered order as each column's own format, and the order that format implies."""
    verdicts = evidence.classify_date_order(date_rows(spark, sf))
    answer = F.when(F.col("dataset_id").startswith("F/"), dates.DAY_FIRST).otherwise(dates.MONTH_FIRST)
    chosen = dates.format_for_order(F.col("day_first_format"), F.col("month_first_format"), F.col("answer"))
    return verdicts.withColumn("answer", answer).withColumn("chosen", chosen).select(
        "dataset_id", "col_idx", "answer", "chosen", dates.implied_order(F.col("chosen")).alias("implied")
    )


@query(
    "date_convert",
    f"""select o_orderkey, cast(o_orderdate as date) as from_day_first, cast(o_orderdate as date) as from_month_first, cast(o_orderdate as date) as from_serial,
      case when day(o_orderdate)<=12 then make_date(year(o_orderdate), cast(day(o_orderdate) as int), cast(month(o_orderdate) as int)) end as from_wrong_order,
      day(o_orderdate)>12 as wrong_flag, cast(null as date) as undeclared, true as undeclared_flag from orders""",
)
def date_convert(spark: SparkSession, sf: str) -> DataFrame:
    cells = dict(zip(DATE_HEADERS, date_cells()))
    none = F.lit(None).cast("string")
    right, _ = convert.to_date_field(cells["day_first"], F.lit("%d/%m/%Y"), F.lit("%m/%d/%Y"))
    short, _ = convert.to_date_field(cells["month_first"], none, F.lit("%m-%d-%y"))
    serial, _ = convert.to_date_field(cells["serial"], F.lit(dates.EXCEL_SERIAL), none)
    wrong, wrong_flag = convert.to_date_field(cells["day_first"], none, F.lit("%m/%d/%Y"))
    nothing, nothing_flag = convert.to_date_field(cells["iso"], none, none)
    return table(spark, sf, "orders").select(
        "o_orderkey", right.alias("from_day_first"), short.alias("from_month_first"), serial.alias("from_serial"),
        wrong.alias("from_wrong_order"), wrong_flag.alias("wrong_flag"), nothing.alias("undeclared"), nothing_flag.alias("undeclared_flag"),
    )


# Declared date fields: one per column of the orders text, some declarations right, some wrong, some absent.
DATE_FIELDS = FieldSet("dates", (
    Field("f_day", "date"), Field("f_month", "date", date_format="%d-%m-%y"), Field("f_iso", "date", date_format="%Y-%m-%d"),
    Field("f_serial", "date", date_format="%d/%m/%Y"), Field("f_open", "date"), Field("f_both", "date", date_format="%d/%m/%Y"),
    Field("f_text", "date"), Field("f_compact", "date"), Field("f_timed", "date"), Field("f_refuted", "date", date_format="%d/%m/%Y"),
))
DATE_MAP = dict(zip(DATE_FIELDS.names, DATE_HEADERS))


def _date_setting(spark: SparkSession, sf: str):
    rows = date_rows(spark, sf)
    ids = rows.select("dataset_id").distinct()
    columns = ids.select("dataset_id", F.posexplode(F.array(*[F.lit(h) for h in DATE_HEADERS])).alias("col_idx", "header"))
    entries = F.array(*[F.struct(F.lit(f).alias("target_field"), F.lit(h).alias("source_column")) for f, h in DATE_MAP.items()])
    mappings = ids.select("dataset_id", F.inline(entries)).withColumn("inferred_value", F.lit(None).cast("string"))
    answers = ids.filter(F.col("dataset_id").startswith("O/")).select("dataset_id", F.lit("f_open").alias("target_field"), F.lit("day_first").alias("order"))
    return rows, columns, mappings, answers


_FIELD_CASE = "case col_idx " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(DATE_FIELDS.names)) + " end"
_DECLARED = "case col_idx " + " ".join(f"when {i} then '{f.date_format}'" for i, f in enumerate(DATE_FIELDS.fields) if f.date_format) + " end"
SQL_DATE_DECIDE = f"""with {SQL_DATE_VERDICT}, named as (select *, {_FIELD_CASE} as target_field, {_DECLARED} as declared, dataset_id like 'O/%' and col_idx=4 as answered from verdict)"""


@query(
    "date_resolve",
    f"""{SQL_DATE_DECIDE} select dataset_id, target_field, case when ord='ambiguous' then day_fmt else {SQL_CHOSEN_FORMAT} end as date_format from named
      where ord='excel_serial' or (ord='ambiguous' and answered) or (ord in ('iso','day_first','month_first') and not coalesce(col_idx=1, false))""",
)
def date_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """The decision table: proven orders resolve, a contradicted declaration does not, an answer settles."""
    rows, columns, mappings, answers = _date_setting(spark, sf)
    formats, _, _ = convert.resolve_date_formats(rows, columns, mappings, DATE_FIELDS.frame(spark), answers)
    return formats


@query(
    "date_conflicts",
    f"""{SQL_DATE_DECIDE}, firsts as (select dataset_id, col_idx, list(v order by row_idx) as vs from (select *, row_number() over (partition by dataset_id,col_idx order by row_idx) as rn from cells) where rn<=3 group by all)
      select n.dataset_id, target_field, day_fmt as day_first_format, month_fmt as month_first_format, array_to_string(vs,'|') as examples, n_nonblank as ambiguous_row_count
      from named n join firsts using (dataset_id,col_idx) where ord='ambiguous' and not answered""",
)
def date_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows, columns, mappings, answers = _date_setting(spark, sf)
    _, conflicts, _ = convert.resolve_date_formats(rows, columns, mappings, DATE_FIELDS.frame(spark), answers)
    return conflicts.select(
        "dataset_id", "target_field", "day_first_format", "month_first_format", F.array_join("example_values", "|").alias("examples"), "ambiguous_row_count"
    )


@query(
    "date_contradictions",
    f"""{SQL_DATE_DECIDE}, firsts as (select dataset_id, col_idx, arg_min(v,row_idx) as v from cells group by all)
      select n.dataset_id, target_field, declared as declared_format, v as example_value from named n join firsts using (dataset_id,col_idx)
      where (ord='month_first' and col_idx=1) or (ord='ambiguous' and not answered and declared is not null)""",
)
def date_contradictions(spark: SparkSession, sf: str) -> DataFrame:
    rows, columns, mappings, answers = _date_setting(spark, sf)
    _, _, contradictions = convert.resolve_date_formats(rows, columns, mappings, DATE_FIELDS.frame(spark), answers)
    return contradictions


@query(
    "date_answers_missing",
    f"""{SQL_DATE_DECIDE} select dataset_id, 'date order of '''||target_field||''' is still undecided' as error from named where ord='ambiguous' and not answered and dataset_id like 'O/%'""",
)
def date_answers_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Datasets that came with answers but leave another date column open."""
    rows, columns, mappings, answers = _date_setting(spark, sf)
    _, conflicts, _ = convert.resolve_date_formats(rows, columns, mappings, DATE_FIELDS.frame(spark), answers)
    return convert.require_date_answers(conflicts, answers)


# ---- counts and redaction ---------------------------------------------------------------------


@query(
    "nonblank_counts",
    """select 'conv-'||cast(conv_id as varchar) as dataset_id, unnest([0,1]) as col_idx, unnest([count(*), count(*) filter (trim(text)<>'')]) as n_nonblank from conversations group by conv_id""",
)
def nonblank_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("dataset_id"), F.col("turn").alias("row_idx"), F.array("role", "text").alias("cells")
    )
    return evidence.nonblank_counts(rows)


@query(
    "redact_types",
    """with g as (select source as sheet, row_number() over (partition by source order by doc_id)-1 as row_idx, doc_id, lang, text from documents),
      d as (select sheet, count(*) as n_rows from g group by sheet),
      b as (select sheet, row_idx, unnest([0,1,2]) as col_idx, unnest([cast(doc_id as varchar), lang, text]) as v from g where row_idx<60)
      select b.sheet, row_idx, col_idx, case when trim(regexp_replace(v,'[\\s\\p{Z}]+',' ','g'))='' then 'blank' when regexp_full_match(trim(v),'[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') then 'num'
        when length(trim(regexp_replace(v,'[\\s\\p{Z}]+',' ','g')))<=8 then 'str:short' when length(trim(regexp_replace(v,'[\\s\\p{Z}]+',' ','g')))<=24 then 'str:med' else 'str:long' end as bucket, n_rows, 3 as n_cols
      from b join d using (sheet)""",
)
def redact_types(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as one sheet per source: the leading window as type buckets, with true dimensions."""
    seen = redact_grid(spark, sf)
    return evidence.redact_to_types(seen).select(
        "sheet", "row_idx", F.posexplode("buckets").alias("col_idx", "bucket"), "n_rows", "n_cols"
    )


def redact_grid(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.common import running_sum

    docs = table(spark, sf, "documents").select("source", "doc_id", "lang", "text")
    placed = running_sum(docs, ["source"], "doc_id", F.lit(1), "row_idx")
    return type_cells(placed.select(
        F.lit("documents").alias("file_id"), F.col("source").alias("sheet"), "row_idx", F.array(F.col("doc_id").cast("string"), "lang", "text").alias("cells")
    ))
