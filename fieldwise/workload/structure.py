"""Raw text, headers, shapes, sheets and layouts over part, supplier, nation, orders, customer, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import header, layout, shape, sheets
from ..operators.common import running_sum
from ..operators.header import type_cells
from ..sources import delimited
from .registry import comma_money, query, sql_comma_money, table

SEP = "|"


def texts(*columns: Column) -> Column:
    return F.array(*[c.cast("string") for c in columns])


def typed(df: DataFrame) -> DataFrame:
    return type_cells(df)


# ---- raw lines --------------------------------------------------------------------------------


@query(
    "comment_strip",
    """with l as (select doc_id, unnest(range(len(string_split(text,chr(10))))) as line_no, unnest(string_split(text,chr(10))) as raw from documents),
      t as (select doc_id, line_no, case when line_no%5=1 then ' # '||raw when line_no%7=3 then 'x"'||raw else raw end as text from l),
      p as (select *, coalesce(sum((length(text)-length(replace(text,'"','')))%2) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding),0)%2 as open from t)
      select doc_id, line_no, length(text) as n_chars from p where open=0 and starts_with(ltrim(text),'#')""",
)
def comment_strip(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a file of lines, some made comments, some opening a quoted cell."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    text = F.when(F.col("line_no") % 5 == 1, F.concat(F.lit(" # "), F.col("raw"))).when(F.col("line_no") % 7 == 3, F.concat(F.lit('x"'), F.col("raw"))).otherwise(F.col("raw"))
    marked = delimited.strip_comment_lines(lines.select("doc_id", "line_no", text.alias("text")), ["doc_id"])
    return marked.filter("is_comment").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.length("text").cast("bigint").alias("n_chars"))


SQL_MIXED = f"""select cast(c_nationkey as varchar)||'-'||cast(c_custkey%4 as varchar) as file_id, c_custkey as line_no,
   concat_ws(case c_custkey%4 when 0 then ',' when 1 then ';' when 2 then chr(9) else '|' end, cast(c_custkey as varchar), '"'||c_name||', Inc"', replace({sql_comma_money('c_acctbal')}, ',', case c_custkey%4 when 1 then ',' else '.' end), c_mktsegment) as text from customer"""


@query(
    "delimiter_detect",
    f"""with l as ({SQL_MIXED}), d as (select unnest([0,1,2,3]) as i, unnest([',',';',chr(9),'|']) as d),
      c as (select file_id, i, d, length(b)-length(replace(b,d,'')) as n from (select file_id, regexp_replace(text,'"[^"]*"','','g') as b from l) cross join d),
      m0 as (select file_id, i, d, n, count(*) as lines from c group by all), m as (select *, sum(lines) over (partition by file_id, i) as total from m0),
      best as (select *, row_number() over (partition by file_id order by lines/total desc, n desc, i) as r from (select *, row_number() over (partition by file_id, i order by lines desc, n desc) as k from m where n>0) where k=1)
      select file_id, d as delimiter from best where r=1""",
)
def delimiter_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as one file per nation and delimiter, with quoted commas inside."""
    return delimited.detect_delimiter(mixed_lines(spark, sf))


def mixed_lines(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("c_custkey") % 4
    mark = F.when(kind == 0, ",").when(kind == 1, ";").when(kind == 2, "\t").otherwise("|")
    money = F.when(kind == 1, comma_money(F.col("c_acctbal"))).otherwise(F.replace(comma_money(F.col("c_acctbal")), F.lit(","), F.lit(".")))
    parts = [F.col("c_custkey").cast("string"), F.concat(F.lit('"'), F.col("c_name"), F.lit(', Inc"')), money, F.col("c_mktsegment")]
    text = F.when(kind == 0, F.concat_ws(",", *parts)).when(kind == 1, F.concat_ws(";", *parts)).when(kind == 2, F.concat_ws("\t", *parts)).otherwise(F.concat_ws("|", *parts))
    return table(spark, sf, "customer").select(
        F.concat_ws("-", F.col("c_nationkey").cast("string"), kind.cast("string")).alias("file_id"), F.col("c_custkey").alias("line_no"), text.alias("text"), mark.alias("mark")
    ).drop("mark")


@query(
    "record_fields",
    """select cast(c_nationkey as varchar)||'-'||cast(c_custkey%4 as varchar) as file_id, count(*) as n_records, sum(length(c_name)+5) as name_chars, min(4) as fewest, max(4) as most from customer group by 1""",
)
def record_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The same files split into fields; quoted names hold commas and, every third line, a line end."""
    lines = mixed_lines(spark, sf)
    cut = F.col("line_no") % 3 == 0
    broken = lines.withColumn("_t", F.when(cut, F.split(F.col("text"), "(?<=#)", 2)).otherwise(F.array("text")))
    two = broken.select("file_id", "line_no", F.posexplode("_t").alias("part", "text")).withColumn("line_no", F.col("line_no") * 2 + F.col("part")).drop("part")
    placed = delimited.place_records(two.join(delimited.detect_delimiter(lines), "file_id"))
    fields = delimited.split_fields(F.col("text"), F.col("delimiter"))
    return delimited.join_records(placed).withColumn("f", fields).groupBy("file_id").agg(
        F.count("*").alias("n_records"), F.sum(F.length(F.replace(F.element_at("f", 2), F.lit("\n"), F.lit("")))).alias("name_chars"),
        F.min(F.size("f")).alias("fewest"), F.max(F.size("f")).alias("most"),
    )


# ---- headers ----------------------------------------------------------------------------------

BANNER_ROWS = 4


def brand_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as one sheet per brand: three banner rows, the header on row 3, then the parts."""
    part = table(spark, sf, "part")
    placed = running_sum(part, ["p_brand"], "p_partkey", F.lit(1), "_n")
    data = placed.select(
        F.lit("parts").alias("file_id"), F.col("p_brand").alias("sheet"), (F.col("_n") + BANNER_ROWS).alias("row_idx"),
        F.array(F.col("p_name"), F.col("p_partkey").cast("string"), F.col("p_type"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 9 == 0, "").otherwise(F.col("p_size").cast("string"))).alias("cells"),
    )
    lead = part.select("p_brand").distinct().select(
        F.lit("parts").alias("file_id"), F.col("p_brand").alias("sheet"),
        F.posexplode(F.array(
            F.array(F.lit("Parts"), F.col("p_brand")), F.array(F.lit(""), F.lit("")), F.array(F.lit("Page"), F.lit("1"), F.lit("of 9")),
            F.array(*[F.lit(h) for h in ("Name", "Key", "Type", "Size", "Weight")]),
        )).alias("row_idx", "cells"),
    )
    return typed(data.unionByName(lead.withColumn("row_idx", F.col("row_idx").cast("bigint"))))


SQL_BRAND_ROWS = """g as (select p_brand as sheet, row_number() over (partition by p_brand order by p_partkey)+3 as row_idx,
    [p_name, cast(p_partkey as varchar), p_type, cast(p_size as varchar), case when p_size%9=0 then '' else cast(p_size as varchar) end] as cells from part
   union all select sheet, unnest([0,1,2,3]), unnest([['Parts',sheet],['',''],['Page','1','of 9'],['Name','Key','Type','Size','Weight']]) from (select distinct p_brand as sheet from part))"""
SQL_TYPED = """c as (select sheet, row_idx, unnest(range(len(cells))) as col_idx, unnest(cells) as raw, len(cells) as w from g),
  t as (select *, case when trim(raw)='' then 'blank' when regexp_full_match(trim(raw),'[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') then 'num' else 'str' end as t from c)"""
SQL_SCORES = f"""{SQL_BRAND_ROWS}, {SQL_TYPED}, dim as (select sheet, max(row_idx)+1 as n_rows, max(w) as width from t group by sheet),
  cand as (select t.sheet, row_idx, any_value(w) as w, count(*) filter (t<>'blank') as n, count(*) filter (t='str') as s, count(distinct case when t<>'blank' then t||chr(31)||case when t='num' then cast(cast(raw as double) as varchar) else raw end end) as u
     from t group by t.sheet,row_idx),
  kinds as (select a.sheet, a.row_idx, b.col_idx, count(*) as k, count(distinct b.t) as d from cand a join t b on a.sheet=b.sheet and b.row_idx between a.row_idx+1 and a.row_idx+5 and b.col_idx<a.w where b.t<>'blank' and a.row_idx<15 group by all),
  cons as (select sheet, row_idx, count(*) filter (d=1)/count(*) as f from kinds where k>=2 group by all),
  sc as (select c.sheet, c.row_idx, 0.3::double*(s/n)+0.2::double*(u/n)+0.2::double*(n/width)+0.3::double*coalesce(f,0) as score from cand c join dim using (sheet) left join cons on cons.sheet=c.sheet and cons.row_idx=c.row_idx where c.n>0 and c.row_idx<least(15,n_rows-1))"""


@query("header_scores", f"with {SQL_SCORES} select sheet, row_idx, round(score,9) as score from sc")
def header_scores(spark: SparkSession, sf: str) -> DataFrame:
    return header.score_header_rows(brand_grid(spark, sf)).select("sheet", "row_idx", F.round("score", 9).alias("score"))


@query(
    "header_detect",
    f"""with {SQL_SCORES}, r as (select *, row_number() over (partition by sheet order by score desc, row_idx) as k, lead(score) over (partition by sheet order by score desc, row_idx) as nxt from sc)
      select sheet, row_idx as header_row, coalesce(score-nxt>=0.05, true) as confident from r where k=1""",
)
def header_detect(spark: SparkSession, sf: str) -> DataFrame:
    return header.detect_header(brand_grid(spark, sf)).select("sheet", "header_row", "confident")


@query(
    "header_slice",
    f"with {SQL_BRAND_ROWS} select sheet, row_idx-4 as row_idx, array_to_string(cells,'|') as cells from g where row_idx>3",
)
def header_slice(spark: SparkSession, sf: str) -> DataFrame:
    grid = brand_grid(spark, sf)
    cut = grid.select("file_id", "sheet").distinct().withColumn("header_row", F.lit(3).cast("bigint"))
    tables = layout.slice_at_header(grid, cut)
    return tables.rows.join(tables.datasets.select("dataset_id", "sheet"), "dataset_id").select("sheet", "row_idx", F.array_join("cells", SEP).alias("cells"))


@query(
    "evidence_window",
    f"with {SQL_BRAND_ROWS} select sheet, 1 as evidence_first_row, string_agg(array_to_string(cells,'|'), '/' order by row_idx) as evidence from g where row_idx between 1 and 8 group by sheet",
)
def evidence_window(spark: SparkSession, sf: str) -> DataFrame:
    grid = brand_grid(spark, sf)
    cut = grid.select("file_id", "sheet").distinct().withColumn("header_row", F.lit(3).cast("bigint"))
    window = layout.evidence_window(grid, cut)
    return window.select("sheet", F.col("evidence_first_row").cast("int").alias("evidence_first_row"), F.array_join(F.transform("evidence_rows", lambda r: F.array_join(r, SEP)), "/").alias("evidence"))


@query(
    "label_disambiguate",
    """with l as (select 'order-'||cast(l_orderkey as varchar) as dataset_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)-1 as col_idx, l_returnflag||l_linestatus as label from lineitem),
      k as (select *, row_number() over (partition by dataset_id,label order by col_idx) as n from l)
      select dataset_id, col_idx, case when n=1 then label else label||' ('||cast(n as varchar)||')' end as header from k""",
)
def label_disambiguate(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a header list of its line flags, duplicates made distinct."""
    li = table(spark, sf, "lineitem").withColumn("_k", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    lists = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("_k", F.concat("l_returnflag", "l_linestatus").alias("label")))).alias("_l"))
    columns = lists.select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("dataset_id"), F.posexplode(F.transform("_l", lambda x: x["label"])).alias("col_idx", "header"))
    return header.disambiguate_labels(columns)


# ---- shapes and sheets ------------------------------------------------------------------------


def shape_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Four kinds of sheet: numeric matrices, plain tables, gapped tables, and flipped ones."""
    li, customer, nation, orders = (table(spark, sf, t) for t in ("lineitem", "customer", "nation", "orders"))
    whole = lambda c: F.round(F.col(c) * 100).cast("bigint").cast("string")
    matrix = li.select(
        F.concat(F.lit("matrix-"), F.col("l_suppkey").cast("string")).alias("sheet"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_idx"),
        F.array(F.col("l_returnflag"), whole("l_discount"), whole("l_tax"), F.col("l_linenumber").cast("string"), F.col("l_orderkey").cast("string")).alias("cells"),
    )
    plain = customer.select(
        F.concat(F.lit("plain-"), F.col("c_nationkey").cast("string")).alias("sheet"), F.col("c_custkey").alias("row_idx"), F.array("c_name", F.col("c_custkey").cast("string"), "c_mktsegment").alias("cells")
    )
    gapped = orders.select(
        F.concat(F.lit("gap-"), F.col("o_orderpriority")).alias("sheet"), F.col("o_orderkey").alias("row_idx"),
        F.when(F.col("o_orderkey") % 50 == 25, F.array(F.lit(""), F.lit(" "))).otherwise(F.array(F.col("o_orderstatus"), F.col("o_orderkey").cast("string"))).alias("cells"),
    )
    lists = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("_n"))
    flipped = lists.select(
        F.concat(F.lit("flip-"), F.col("n_regionkey").cast("string")).alias("sheet"),
        F.posexplode(F.array(
            F.concat(F.array(F.lit("name")), F.transform("_n", lambda n: n["n_name"])),
            F.concat(F.array(F.lit("key")), F.transform("_n", lambda n: n["n_nationkey"].cast("string"))),
        )).alias("row_idx", "cells"),
    ).withColumn("row_idx", F.col("row_idx").cast("bigint"))
    merged = matrix.unionByName(plain).unionByName(gapped).unionByName(flipped)
    return typed(merged.select(F.lit("book").alias("file_id"), "sheet", "row_idx", "cells"))


_W = "cast(cast(round({0}*100) as bigint) as varchar)"
SQL_SHAPE_ROWS = f"""g as (select 'matrix-'||cast(l_suppkey as varchar) as sheet, l_orderkey*8+l_linenumber as row_idx, [l_returnflag, {_W.format('l_discount')}, {_W.format('l_tax')}, cast(l_linenumber as varchar), cast(l_orderkey as varchar)] as cells from lineitem
  union all select 'plain-'||cast(c_nationkey as varchar), c_custkey, [c_name, cast(c_custkey as varchar), c_mktsegment] from customer
  union all select 'gap-'||o_orderpriority, o_orderkey, case when o_orderkey%50=25 then ['',' '] else [o_orderstatus, cast(o_orderkey as varchar)] end from orders
  union all select 'flip-'||cast(n_regionkey as varchar), unnest([0,1]), unnest([list_concat(['name'], list(n_name order by n_nationkey)), list_concat(['key'], list(cast(n_nationkey as varchar) order by n_nationkey))]) from nation group by n_regionkey)"""
# Two grid rows of a matrix may share a row number, so rows are told apart by a running number.
SQL_SHAPES = f"""{SQL_SHAPE_ROWS.replace('g as (', 'g0 as (')}, g as (select *, row_number() over () as rid from g0),
  c as (select sheet, row_idx, rid, unnest(range(len(cells))) as col_idx, unnest(cells) as raw, len(cells) as w from g),
  t as (select *, case when trim(raw)='' then 'blank' when regexp_full_match(trim(raw),'[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') then 'num' else 'str' end as t from c),
  rows_ as (select sheet, rid, any_value(row_idx) as row_idx, max(w) as w, bool_and(t='blank') as blank, count(*) filter (col_idx>0 and t<>'blank') as n, greatest(count(*) filter (col_idx>0 and t='str'), count(*) filter (col_idx>0 and t='num')) as m from t group by sheet, rid),
  rowh as (select sheet, max(w) as width, avg(case when n>0 then m/n else 1 end) as rh, min(row_idx) filter (blank) as fb, max(row_idx) filter (blank) as lb, min(row_idx) filter (not blank) as ff, max(row_idx) filter (not blank) as lf from rows_ group by sheet),
  cols as (select sheet, col_idx, count(*) filter (t<>'blank') as n, count(*) filter (t='num') as nn, greatest(count(*) filter (t='str'), count(*) filter (t='num')) as m, min(try_cast(raw as double)) filter (t='num') as lo, max(try_cast(raw as double)) filter (t='num') as hi from t group by sheet, col_idx),
  colh as (select sheet, avg(case when n>0 then m/n else 1 end) as ch from cols group by sheet),
  isl as (select *, case when lo > max(hi) over (partition by sheet order by lo, hi, col_idx rows between unbounded preceding and 1 preceding) then 1 else 0 end as nw from cols where n>=2 and nn=n),
  grp as (select sheet, gid, count(*) as k from (select *, sum(nw) over (partition by sheet order by lo, hi, col_idx) as gid from isl) group by all),
  clu as (select sheet, max(k) as k from grp group by sheet),
  fst as (select sheet, count(*) filter (t<>'blank') as fv, count(*) filter (t='str') as fs, count(distinct raw) filter (t='str') as fd from t where col_idx=0 group by sheet)
  select r.sheet, case when ff<fb and lf>lb then 'multiple_tables' when rh-ch>=0.1 and fv>0 and fs=fv and fd=fv then 'transposed' when k>=3 and k/width>=0.4 then 'wide_matrix' else 'row_per_record' end as shape
  from rowh r join colh using (sheet) left join clu using (sheet) join fst using (sheet)"""


@query("shape_classify", f"with {SQL_SHAPES}")
def shape_classify(spark: SparkSession, sf: str) -> DataFrame:
    return shape.classify_shape(shape_grid(spark, sf)).select("sheet", "shape")


@query("shape_questions", f"with s as (with {SQL_SHAPES}) select sheet, shape as unsure_about, false as answerable_by_hint from s where shape<>'row_per_record'")
def shape_questions(spark: SparkSession, sf: str) -> DataFrame:
    grid = shape_grid(spark, sf)
    return layout.structure_questions(shape.classify_shape(grid), grid).select("sheet", "unsure_about", "answerable_by_hint")


def event_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Events as workbooks, one per user, one sheet per event type, wider sheets for some types."""
    events = running_sum(table(spark, sf, "events"), ["user_id", "event_type"], "event_id", F.lit(1), "row_idx")
    base = [F.col("event_id").cast("string"), F.col("event_type")]
    wide = [*base, F.col("props"), F.when(F.col("event_id") % 3 == 0, "").otherwise("x"), F.lit("y")]
    cells = F.when(F.col("event_type") == "purchase", F.array(*wide)).when(F.col("event_type").isin("view", "click"), F.array(*base[::-1], F.col("props"))).otherwise(F.array(*base))
    return typed(events.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("file_id"), F.col("event_type").alias("sheet"), "row_idx", cells.alias("cells")))


SQL_RANK = """e as (select 'user-'||cast(user_id as varchar) as file_id, event_type as sheet, case when event_type='purchase' then [cast(event_id as varchar), event_type, props, case when event_id%3=0 then '' else 'x' end, 'y'] when event_type in ('view','click') then [event_type, cast(event_id as varchar), props] else [cast(event_id as varchar), event_type] end as cells from events),
  s as (select file_id, sheet, count(*) as n_rows, max(len(cells)) as n_cols, sum(len(list_filter(cells, lambda x: trim(x)<>''))) as filled, count(distinct cells[1])/count(cells[1]) as uq from e group by all),
  w as (select *, max(n_cols) over (partition by file_id)*0.5 as th from s),
  k as (select file_id, sheet, 0.3::double*(filled/(n_rows*n_cols))+0.4::double*least(n_cols/th,1)+0.2::double*least(n_rows/2,1)+0.1::double*uq as score from w),
  r as (select *, row_number() over (partition by file_id order by score desc, sheet) as rank from k),
  f as (select file_id, coalesce(max(score) filter (rank=1)-max(score) filter (rank=2)>=0.1, true) as confident, string_agg(sheet, ',' order by rank) as sheets, max(sheet) filter (rank=1) as top from r group by file_id)"""


@query("sheet_rank", f"with {SQL_RANK} select r.file_id, sheet, round(score,9) as score, rank, confident from r join f using (file_id)")
def sheet_rank(spark: SparkSession, sf: str) -> DataFrame:
    return sheets.rank_sheets(event_grid(spark, sf)).withColumn("score", F.round("score", 9))


@query("sheet_choice", f"with {SQL_RANK} select file_id, case when file_id like '%5' then 'view' else top end as sheet from f where (file_id like '%5' and (','||sheets||',') like '%,view,%') or (file_id not like '%5' and confident)")
def sheet_choice(spark: SparkSession, sf: str) -> DataFrame:
    ranking = sheets.rank_sheets(event_grid(spark, sf))
    answers = ranking.select("file_id").distinct().filter(F.col("file_id").endswith("5")).withColumn("sheet", F.lit("view"))
    chosen, _, _ = sheets.choose_sheet(ranking, answers)
    return chosen


@query("sheet_questions", f"with {SQL_RANK} select file_id, sheets as candidates from f where not confident")
def sheet_questions(spark: SparkSession, sf: str) -> DataFrame:
    _, questions, _ = sheets.choose_sheet(sheets.rank_sheets(event_grid(spark, sf)))
    return questions.select("file_id", F.array_join("candidates", ",").alias("candidates"))


@query(
    "sheet_inventory",
    """with b as (select p_brand as sheet, count(*) as row_count, min(p_partkey)<=max(p_size) as matrix from part group by p_brand)
      select sheet, case when matrix then 'unsupported_shape' else 'ok' end as status, case when matrix then '' else 'Name|Key|Type|Size|Weight' end as headers, row_count from b""",
)
def sheet_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Every brand sheet with its status, headers and row count; three chained numeric ranges make a matrix."""
    return sheets.describe_sheets(brand_grid(spark, sf)).select("sheet", "status", F.array_join("headers", SEP).alias("headers"), "row_count")


# ---- layouts ----------------------------------------------------------------------------------

TABLE_ROWS = 40


def stacked_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as one long sheet of stacked tables, forty rows each: a title, a header, then data."""
    kind = F.col("o_orderkey") % TABLE_ROWS
    cells = F.when(kind == 0, texts(F.lit(""), F.concat(F.lit("Panel "), F.floor(F.col("o_orderkey") / TABLE_ROWS).cast("string")))).when(
        kind == 1, texts(F.lit("Key"), F.lit(" Status "), F.lit("Priority"))
    ).otherwise(texts(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")))
    return typed(table(spark, sf, "orders").select(F.lit("orders").alias("file_id"), F.lit("stack").alias("sheet"), F.col("o_orderkey").alias("row_idx"), cells.alias("cells")))


def stacked_fences(spark: SparkSession, sf: str) -> DataFrame:
    """One fence per table; the last may be shorter."""
    block = F.floor(F.col("o_orderkey") / TABLE_ROWS).alias("table_idx")
    return table(spark, sf, "orders").groupBy(block).agg(F.max("o_orderkey").alias("last_row")).select(
        F.lit("orders").alias("file_id"), F.lit("stack").alias("sheet"), F.col("table_idx").cast("int").alias("table_idx"), (F.col("table_idx") * TABLE_ROWS + 1).alias("header_row"),
        (F.col("table_idx") * TABLE_ROWS + 2).alias("first_row"), "last_row", (F.col("table_idx") * TABLE_ROWS).alias("title_row"),
    )


@query(
    "fence_tables",
    f"select o_orderkey//{TABLE_ROWS} as table_idx, o_orderkey%{TABLE_ROWS}-2 as row_idx, cast(o_orderkey as varchar)||'|'||o_orderstatus||'|'||o_orderpriority as cells from orders where o_orderkey%{TABLE_ROWS}>=2",
)
def fence_tables(spark: SparkSession, sf: str) -> DataFrame:
    tables, _ = layout.fence_tables(stacked_grid(spark, sf), stacked_fences(spark, sf))
    return tables.rows.join(tables.datasets.select("dataset_id", "table_idx"), "dataset_id").select("table_idx", "row_idx", F.array_join("cells", SEP).alias("cells"))


@query(
    "table_titles",
    f"select o_orderkey//{TABLE_ROWS} as table_idx, 'Panel '||cast(o_orderkey//{TABLE_ROWS} as varchar) as title, 'rows '||cast(min(o_orderkey)+2 as varchar)||'-'||cast(max(o_orderkey)+1 as varchar) as label from orders group by 1,2",
)
def table_titles(spark: SparkSession, sf: str) -> DataFrame:
    return layout.table_titles(stacked_grid(spark, sf), stacked_fences(spark, sf)).select("table_idx", "title", "label")


def label_grid(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet per customer nation: segment labels left, two value columns, a blank row now and then."""
    customer = running_sum(table(spark, sf, "customer"), ["c_nationkey"], "c_custkey", F.lit(1), "row_idx")
    blank = F.col("c_custkey") % 11 == 0
    cells = F.when(blank, texts(F.lit(""), F.lit(" "), F.lit(""))).otherwise(texts(F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_mktsegment")), F.col("c_custkey"), F.col("c_name")))
    return typed(customer.select(F.lit("labels").alias("file_id"), F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("sheet"), "row_idx", cells.alias("cells")))


def label_layouts(grid: DataFrame, melt: bool) -> DataFrame:
    sizes = layout.grid_sizes(grid)
    block = F.struct(F.lit(0).alias("label_column"), F.array(F.lit(1), F.lit(2)).alias("value_columns"), F.lit(0).cast("bigint").alias("first_row"), (F.col("n_rows") - 1).alias("last_row"))
    none = F.lit(None).cast("bigint")
    tables = F.array().cast("array<struct<header_row_index:bigint,first_data_row:bigint,last_data_row:bigint,title_row_index:bigint>>")
    return sizes.select(
        "file_id", "sheet", F.lit("key_value").alias("kind"), F.lit(1.0).alias("confidence"), F.lit("given").alias("reasoning"), none.alias("header_row_index"), none.alias("first_data_row"),
        none.alias("last_data_row"), F.array(block).alias("key_value_blocks"), F.lit(melt).alias("one_record_per_value_column"), tables.alias("tables"),
    )


SQL_LABELS = """l as (select 'nation-'||cast(c_nationkey as varchar) as sheet, row_number() over (partition by c_nationkey order by c_custkey)-1 as row_idx, case when c_custkey%7=0 then '' else c_mktsegment end as label, cast(c_custkey as varchar) as a, c_name as b from customer where c_custkey%11<>0)"""


@query(
    "unpivot_labels",
    f"""with {SQL_LABELS}, e as (select sheet, row_idx*2 as o, label, a as v from l union all select sheet, row_idx*2+1, label, b from l), p as (select *, row_number() over (partition by sheet order by o)-1 as col_idx, row_number() over (partition by sheet,label order by o) as n from e)
      select sheet, 0 as row_idx, col_idx, case when label='' then '' when n=1 then label else label||' ('||cast(n as varchar)||')' end as header, v from p""",
)
def unpivot_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _unpivoted(spark, sf, melt=False)


@query(
    "melt_labels",
    f"""with {SQL_LABELS}, p as (select *, row_number() over (partition by sheet order by row_idx)-1 as col_idx, row_number() over (partition by sheet,label order by row_idx) as n from l)
      select sheet, r as row_idx, col_idx, case when label='' then '' when n=1 then label else label||' ('||cast(n as varchar)||')' end as header, case r when 0 then a else b end as v from p, (select unnest([0,1]) as r)""",
)
def melt_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _unpivoted(spark, sf, melt=True)


def _unpivoted(spark: SparkSession, sf: str, melt: bool) -> DataFrame:
    grid = label_grid(spark, sf)
    tables = layout.unpivot_key_value(grid, label_layouts(grid, melt))
    cells = tables.rows.select("dataset_id", "row_idx", F.posexplode("cells").alias("col_idx", "v"))
    return cells.join(tables.columns, ["dataset_id", "col_idx"]).join(tables.datasets.select("dataset_id", "sheet"), "dataset_id").select("sheet", "row_idx", "col_idx", "header", "v")


@query(
    "layout_closure",
    f"""with {SQL_BRAND_ROWS}, d as (select sheet, max(row_idx)+1 as n_rows from g group by sheet), s as (select *, cast(sheet[7:] as int) as k from d)
      select sheet, case k%5 when 0 then 'unknown' when 1 then 'row_per_record' when 2 then 'unknown' when 3 then 'wide_matrix' else 'unknown' end as kind,
        case k%5 when 1 then 1.0 when 3 then 0.4 else 0.0 end::double as confidence, case k%5 when 1 then 3 end as header_row_index from s""",
)
def layout_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts from outside, some missing, out of the grid, inverted, doubled or over-confident."""
    grid = brand_grid(spark, sf)
    return layout.close_layouts(brand_verdicts(grid), grid).select("sheet", "kind", "confidence", F.col("header_row_index").cast("int").alias("header_row_index"))


def brand_verdicts(grid: DataFrame) -> DataFrame:
    sizes = layout.grid_sizes(grid).withColumn("_k", F.regexp_extract("sheet", "([0-9]+)", 1).cast("int") % 5).filter("_k <> 0")
    k = F.col("_k")
    none = F.lit(None).cast("bigint")
    first = sizes.select(
        "file_id", "sheet", F.lit(1).alias("position"), F.when(k == 3, "wide_matrix").otherwise("row_per_record").alias("kind"),
        F.when(k == 1, 1.7).otherwise(0.4).cast("double").alias("confidence"), F.lit("judged").alias("reasoning"),
        F.when(k == 1, F.lit(3)).when(k == 2, F.col("n_rows")).cast("bigint").alias("header_row_index"), F.when(k == 4, 5).cast("bigint").alias("first_data_row"),
        F.when(k == 4, 2).cast("bigint").alias("last_data_row"), F.array().cast("array<struct<label_column:int,value_columns:array<int>,first_row:bigint,last_row:bigint>>").alias("key_value_blocks"),
        F.lit(False).alias("one_record_per_value_column"), F.array().cast("array<struct<header_row_index:bigint,first_data_row:bigint,last_data_row:bigint,title_row_index:bigint>>").alias("tables"),
    )
    second = first.withColumn("position", F.lit(2)).withColumn("kind", F.lit("not_a_table"))
    stranger = first.withColumn("sheet", F.concat(F.lit("no "), F.col("sheet")))
    return first.unionByName(second).unionByName(stranger).withColumn("header_row_index", F.coalesce("header_row_index", none))


@query(
    "layout_decision",
    f"""with {SQL_BRAND_ROWS}, s as (select distinct sheet, cast(sheet[7:] as int) as k from g)
      select sheet, case when k%5=1 then 'row_per_record' end as readable, case k%5 when 1 then null when 3 then 'layout looks like wide_matrix' else 'layout looks like unknown' end as question from s""",
)
def layout_decision(spark: SparkSession, sf: str) -> DataFrame:
    grid = brand_grid(spark, sf)
    closed = layout.close_layouts(brand_verdicts(grid), grid)
    readable, questions = layout.decide_layout(closed)
    return readable.select("sheet", F.col("kind").alias("readable"), F.lit(None).cast("string").alias("question")).unionByName(
        questions.select("sheet", F.lit(None).cast("string").alias("readable"), F.col("unsure_about").alias("question"))
    )
