"""Exports, names, selections, pending reviews and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Field, FieldSet
from ..operators.layout import sample_rows
from ..session import run_folder
from ..sinks import export
from ..sources.delimited import scan_delimited
from ..streaming.ingest import ingested, stream_ingest
from ..streaming.pending import current_states, expire_pending, start_pending, watch_pending
from .registry import comma_money, query, sql_values, table

_SLUG = "trim(regexp_replace(lower({0}),'[^a-z0-9]+','-','g'),'-')"


@query(
    "export_keys",
    f"""with p as (select page_id, url, regexp_extract(url,'//([^/]+)',1) as host, regexp_extract(url,'([^/]*)$',1) as leaf from pages),
      s as (select page_id, host, url, case when length(leaf)>1 and strpos(leaf[2:],'.')>0 then regexp_replace(leaf,'\\.[^.]*$','') else leaf end as stem, case when page_id%3=0 then url else host end as sheet from p)
      select page_id, coalesce(nullif(concat_ws('__', nullif({_SLUG.format('host')},''), nullif({_SLUG.format('stem')},''), case when sheet<>url then nullif({_SLUG.format('sheet')},'') end),''),'export') as export_key from s""",
)
def export_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A page's host as vendor, its address as source file; the sheet sometimes only repeats the file."""
    host = F.regexp_extract("url", "//([^/]+)", 1)
    sheet = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(host)
    return table(spark, sf, "pages").select("page_id", export.export_key(host, F.col("url"), sheet).alias("export_key"))


@query(
    "safe_names",
    """with m as (select s_nationkey as file_id, s_suppkey as idx, s_nationkey, case s_suppkey%3 when 0 then '../Data' when 1 then 'Data..2025' else '///' end as name from supplier),
      c as (select file_id, idx, trim(regexp_replace(regexp_replace(name,'[^A-Za-z0-9._ -]','','g'),'\\.{2,}','.','g'),' .') as s from m),
      d as (select file_id, idx, case when s='' then 'sheet_'||cast(idx as varchar) else s end as s from c)
      select 'file-'||cast(file_id as varchar) as file_id, idx, case when row_number() over (partition by file_id, s order by idx)=1 then s else s||'_'||cast(idx as varchar) end as safe from d""",
)
def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    members = table(spark, sf, "supplier").select(
        F.concat(F.lit("file-"), F.col("s_nationkey").cast("string")).alias("file_id"), F.col("s_suppkey").alias("idx"), F.when(k == 0, "../Data").when(k == 1, "Data..2025").otherwise("///").alias("name")
    )
    return export.safe_names(members)


@query(
    "member_names",
    """with m as (select 'f'||cast(c_nationkey as varchar) as file_id, c_mktsegment as sheet, case when c_custkey%10=0 then null else c_custkey end as table_idx, case when c_custkey%4=0 then '' else 'T'||cast(c_custkey%20 as varchar) end as title, 'rows '||cast(c_custkey as varchar) as label from customer)
      select file_id, sheet, label, case when table_idx is null then sheet when title<>'' and count(*) over (partition by file_id,sheet,title)=1 then sheet||' — '||title when title<>'' then sheet||' — '||title||' ('||label||')' else sheet||' — '||label end as member from m""",
)
def member_names(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    members = table(spark, sf, "customer").select(
        F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("file_id"), F.col("c_mktsegment").alias("sheet"), F.when(k % 10 != 0, k).alias("table_idx"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("T"), (k % 20).cast("string"))).alias("title"), F.concat(F.lit("rows "), k.cast("string")).alias("label"),
    )
    return export.member_names(members).select("file_id", "sheet", "label", "member")


@query(
    "selection_check",
    """with man as (select 'order-'||cast(l_orderkey as varchar) as file_id, 'line '||cast(l_linenumber as varchar) as sheet, min(l_partkey) as position from lineitem group by all),
      sel as (select distinct 'order-'||cast(l_orderkey as varchar) as file_id, 'line '||cast(case when l_orderkey%10=0 then l_linenumber+1 else l_linenumber end as varchar) as sheet, l_returnflag as schema_name from lineitem),
      bad as (select distinct file_id from sel where schema_name not in ('A','N') or not exists (select 1 from man where man.file_id=sel.file_id and man.sheet=sel.sheet))
      select s.file_id, s.sheet, s.schema_name, position from sel s join man on man.file_id=s.file_id and man.sheet=s.sheet where s.file_id not in (select file_id from bad)""",
)
def selection_check(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as offered tables; one unknown table or schema rejects the whole order."""
    li = table(spark, sf, "lineitem")
    file_id = F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("file_id")
    line = lambda n: F.concat(F.lit("line "), n.cast("string")).alias("sheet")
    manifest = li.groupBy(file_id, line(F.col("l_linenumber"))).agg(F.min("l_partkey").alias("position")).withColumn("table_idx", F.lit(None).cast("int"))
    shifted = F.when(F.col("l_orderkey") % 10 == 0, F.col("l_linenumber") + 1).otherwise(F.col("l_linenumber"))
    chosen = li.select(file_id, line(shifted), F.lit(None).cast("int").alias("table_idx"), F.col("l_returnflag").alias("schema_name")).distinct()
    schemas = li.select(F.col("l_returnflag").alias("schema_name")).distinct().filter(F.col("schema_name").isin("A", "N"))
    good, _ = export.apply_selections(manifest, chosen, schemas)
    return good.select("file_id", "sheet", "schema_name", "position")


@query("sample_turns", "select conv_id, turn, role from conversations where turn < 3")
def sample_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The first three turns of every conversation by position: the sampling operator itself."""
    rows = table(spark, sf, "conversations").withColumn("row_idx", F.col("turn"))
    return sample_rows(rows, 3).select("conv_id", "turn", "role")


# ---- pending reviews --------------------------------------------------------------------------

NOW = "2024-01-30 12:00:00"


def _tokens(events: DataFrame, kind: str) -> DataFrame:
    return events.filter(F.col("event_type") == kind).select(F.concat_ws("/", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("token"), F.col("ts").cast("timestamp").alias("ts"))


SQL_TOKENS = "tk as (select cast(user_id as varchar)||'/'||json_extract_string(props,'$.k') as token, event_type, ts from events)"


@query(
    "pending_expiry",
    f"""with {SQL_TOKENS}, p as (select token, min(ts) as created_at from tk where event_type='signup' group by token),
      c as (select p.token, min(tk.ts) as confirmed_at from p join tk on tk.token=p.token and tk.event_type='purchase' and tk.ts>=p.created_at and tk.ts<=timestamp '{NOW}' group by p.token)
      select p.token, created_at, confirmed_at, case when confirmed_at<created_at+interval 24 hour then 'confirmed' when confirmed_at is not null then 'late' when created_at+interval 24 hour>timestamp '{NOW}' then 'live' else 'expired' end as state from p left join c using (token)""",
)
def pending_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Signups open reviews, purchases of the same user and key confirm them."""
    events = table(spark, sf, "events")
    pending = _tokens(events, "signup").groupBy("token").agg(F.min("ts").alias("created_at"))
    return expire_pending(pending, _tokens(events, "purchase").withColumnRenamed("ts", "confirmed_at"), F.lit(NOW).cast("timestamp"))


def _fresh_folder(spark: SparkSession) -> str:
    return f"{run_folder(spark)}/{uuid.uuid4().hex}"


_STREAMED = f"""with {SQL_TOKENS}, w as (select date_trunc('millisecond', max(ts)) - interval 10 minute as seen from tk where event_type in ('signup', 'purchase')),
      s as (select token, min(ts) as created_at from tk, w where event_type='signup' and ts<seen+interval 1 millisecond group by token),
      b as (select token, ts from tk, w where event_type='purchase' and ts<seen+interval 1 millisecond),
      c as (select s.token, min(b.ts) as confirmed_at from s join b on b.token=s.token and b.ts>=s.created_at group by s.token),
      x as (select s.token, created_at, confirmed_at, case when confirmed_at<created_at+interval 24 hour then 'confirmed' when confirmed_at is not null then 'late' when created_at+interval 24 hour<=seen then 'expired' else 'live' end as state from s left join c using (token), w)"""


def _watched(spark: SparkSession, sf: str) -> str:
    """The event files as a stream, until all input is read: the folder its sinks are in."""
    source = table(spark, sf, "events")
    folder = _fresh_folder(spark)
    source.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{folder}/in")
    opened = _tokens(stream, "signup").withColumnRenamed("ts", "created_at")
    closed = _tokens(stream, "purchase").withColumnRenamed("ts", "confirmed_at")
    start_pending(watch_pending(opened, closed), f"{folder}/out", f"{folder}/state").awaitTermination()
    return f"{folder}/out"


@query("pending_stream", f"{_STREAMED} select * from x")
def pending_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews as a stream leaves them: live, confirmed, expired, and confirmed too late."""
    return current_states(spark, _watched(spark, sf))


@query("pending_rejects", f"""{_STREAMED} select token, confirmed_at, 'late' as reason from x where state='late'
      union all select b.token, b.ts, 'unknown' from b left join s using (token) where s.token is null or b.ts<s.created_at""")
def pending_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Confirmations that the stream turned away: of an expired review, or of one that was never opened."""
    return spark.read.schema("token string, confirmed_at timestamp, reason string").parquet(f"{_watched(spark, sf)}/rejects").select("token", "confirmed_at", "reason")


# ---- files in, tables out ---------------------------------------------------------------------

CLIENTS = FieldSet("clients", (Field("c_custkey", "integer"), Field("c_name", "text"), Field("c_mktsegment", "text"), Field("c_acctbal", "number"), Field("since", "date")))


def landing_files(spark: SparkSession, sf: str) -> str:
    """Customers as semicolon files with decimal commas, one folder, many files."""
    folder = f"{_fresh_folder(spark)}/landing"
    k = F.col("c_custkey")
    lines = table(spark, sf, "customer").select(
        k.alias("C_CustKey"), F.col("c_name").alias("c_name"), F.concat(F.lit("seg; "), F.col("c_mktsegment")).alias("c_mktsegment"), comma_money(F.col("c_acctbal")).alias("c_acctbal"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 1000).cast("int")), "dd.MM.yyyy").alias("since"),
    )
    lines.write.option("header", True).option("sep", ";").csv(folder)
    return folder


SQL_CLIENTS = "select c_custkey, c_name, 'seg; '||c_mktsegment as c_mktsegment, c_acctbal, date '2020-01-01'+cast(c_custkey%1000 as int) as since from customer"


@query("ingest_stream", SQL_CLIENTS)
def ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Files land, the stream maps, checks and types them, and ready datasets come out as records."""
    landing, folder = landing_files(spark, sf), _fresh_folder(spark)
    stream_ingest(spark, landing, CLIENTS, f"{folder}/out", f"{folder}/state").awaitTermination()
    return ingested(spark, f"{folder}/out", "tidy").select(*CLIENTS.names)


@query("ingest_replay", f"with t as ({SQL_CLIENTS}) select *, 'tidy' as state from t")
def ingest_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The same files through a second stream that knows nothing of the first: every sink holds what it held."""
    landing, folder = landing_files(spark, sf), _fresh_folder(spark)
    for attempt in range(2):
        stream_ingest(spark, landing, CLIENTS, f"{folder}/out", f"{folder}/state-{attempt}").awaitTermination()
    status = spark.read.parquet(f"{folder}/out/status").select("dataset_id", "state")
    return ingested(spark, f"{folder}/out", "tidy").join(status, "dataset_id").select(*CLIENTS.names, "state")


@query("delimited_scan", SQL_CLIENTS.replace("c_acctbal,", "cast(c_acctbal*100 as bigint) as cents,").replace("cast(c_acctbal*100 as bigint)", "cast(round(c_acctbal*100) as bigint)"))
def delimited_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same files read back by the scanner alone."""
    scan = scan_delimited(spark, landing_files(spark, sf))
    at = lambda i: F.element_at("cells", i)
    return scan.tables.rows.select(
        at(1).cast("bigint").alias("c_custkey"), at(2).alias("c_name"), at(3).alias("c_mktsegment"), F.regexp_replace(at(4), "[.,]", "").cast("bigint").alias("cents"), F.to_date(at(5), "dd.MM.yyyy").alias("since")
    )


@query("export_tidy", "select c_custkey, c_name, cast(round(c_acctbal*100) as bigint) as cents, 'north__nation-'||cast(c_nationkey as varchar) as export_key from customer where c_nationkey%5<>0")
def export_tidy(spark: SparkSession, sf: str) -> DataFrame:
    """Customers exported per nation as text and read back; datasets that are not ready stay out."""
    customer = table(spark, sf, "customer")
    fields = FieldSet("c", (Field("c_custkey", "integer"), Field("c_name", "text"), Field("c_acctbal", "number")))
    tidy = customer.select(F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("dataset_id"), F.col("c_custkey").alias("row_idx"), "c_custkey", "c_name", "c_acctbal")
    ids = tidy.select("dataset_id").distinct()
    ready = ids.withColumn("ready", F.regexp_extract("dataset_id", "([0-9]+)", 1).cast("int") % 5 != 0)
    keys = ids.withColumn("export_key", export.export_key(F.lit("North"), F.concat("dataset_id", F.lit(".csv")), F.concat("dataset_id", F.lit(".csv"))))
    path = f"{_fresh_folder(spark)}/export"
    export.export(tidy, ready, keys, fields, path, "csv")
    back = spark.read.option("header", True).schema("c_custkey bigint, c_name string, c_acctbal double, export_key string").csv(path)
    return back.select("c_custkey", "c_name", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("cents"), "export_key")


# Each kind of file, and the error it must give.
FILE_KINDS = {
    "good": None,
    "ragged": "some rows have more values than the header has names",
    "wider": "each row has one more value than the header has names",
    "open": "a quoted cell is never closed",
    "comments": "it holds no line of data",
    "hashed": "a line starting with '#' has as many columns as the table, so it may be its header",
    "text": "unsupported format '.txt'",
}


@query(
    "scan_errors",
    f"""with k as (select * from {sql_values([(a, b) for a, b in FILE_KINDS.items() if b], ['kind', 'error'])}), n as (select distinct c_nationkey from customer)
      select kind, c_nationkey, error from k cross join n""",
)
def scan_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of a nation as one file of every kind: good ones give no error, each other kind its own, named."""
    folder = f"{_fresh_folder(spark)}/kinds"
    kind, k = F.col("kind"), F.col("c_custkey").cast("string")
    plain = F.concat_ws(",", k, F.col("c_mktsegment"), F.lit("x"))
    line = (
        F.when((kind == "wider") | ((kind == "ragged") & (F.col("c_custkey") == F.col("least"))), F.concat_ws(",", plain, F.lit("more")))
        .when((kind == "open") & (F.col("c_custkey") == F.col("least")), F.concat(k, F.lit(',"never,closed')))
        .when(kind == "comments", F.concat(F.lit("\u00a0# "), plain))
        .otherwise(plain)
    )
    heading = F.when(kind == "comments", "\u00a0# only").when(kind == "hashed", "\u00a0#key,segment,note").otherwise("key,segment,note")
    customer = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_mktsegment", F.explode(F.array(*map(F.lit, FILE_KINDS))).alias("kind"))
    firsts = customer.groupBy("kind", "c_nationkey").agg(F.min("c_custkey").alias("least"))
    data = customer.join(firsts, ["kind", "c_nationkey"]).select("kind", "c_nationkey", F.col("c_custkey").alias("at"), line.alias("value"))
    heads = firsts.select("kind", "c_nationkey", F.lit(-1).cast("bigint").alias("at"), heading.alias("value"))
    lines = data.unionByName(heads).repartition("kind", "c_nationkey").sortWithinPartitions("kind", "c_nationkey", "at")
    raw = {"sep": "\u0001", "quote": "\u0000", "escape": "\u0000", "escapeQuotes": "false", "emptyValue": ""}
    lines.filter("kind <> 'text'").select("kind", "c_nationkey", "value").write.partitionBy("kind", "c_nationkey").options(**raw).csv(folder)
    lines.filter("kind = 'text'").select("kind", "c_nationkey", "value").write.mode("append").partitionBy("kind", "c_nationkey").text(folder)
    scan = scan_delimited(spark, folder)
    return scan.errors.select(
        F.regexp_extract("file_id", "kind=([a-z]+)", 1).alias("kind"), F.regexp_extract("file_id", "c_nationkey=([0-9]+)", 1).cast("int").alias("c_nationkey"),
        F.regexp_replace("error", "^Cannot ingest [^:]*: ", "").alias("error"),
    )
