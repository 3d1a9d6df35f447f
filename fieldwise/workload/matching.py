"""Signatures, profiles, aliases, scores, vendors and near matches over customer, supplier and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NEAR_MAX_EDITS, NEAR_MAX_RATIO
from ..operators import closures, matching, near
from .registry import query, sql_values, table

NORM = "lower(trim(regexp_replace({0},'\\s+',' ','g')))"


def customer_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A header list per customer: case, spacing and order vary by key, one label differs by segment."""
    k = F.col("c_custkey")
    base = [F.lit("Order Key"), F.lit("quantity"), F.col("c_mktsegment"), F.lit("Unit"), F.lit("unit")]
    shouted = [F.lit("ORDER   KEY "), F.upper("c_mktsegment"), F.lit("Quantity"), F.lit("UNIT"), F.lit(" Unit")]
    names = F.when(k % 3 == 0, F.array(*shouted)).otherwise(F.array(*base))
    return table(spark, sf, "customer").select(F.concat(F.lit("customer-"), k.cast("string")).alias("dataset_id"), F.posexplode(names).alias("col_idx", "header"))


SQL_CC = """cc as (select c_custkey, 'customer-'||cast(c_custkey as varchar) as dataset_id, unnest([0,1,2,3,4]) as col_idx,
  unnest(case when c_custkey%3=0 then ['ORDER   KEY ',upper(c_mktsegment),'Quantity','UNIT',' Unit'] else ['Order Key','quantity',c_mktsegment,'Unit','unit'] end) as header from customer)"""
SQL_SIG = f"""{SQL_CC}, cn as (select *, {NORM.format('header')} as norm from cc), sig as (select dataset_id, any_value(c_custkey) as c_custkey, sha256('["'||array_to_string(list_sort(list(norm)),'","')||'"]') as column_signature from cn group by dataset_id)"""


@query("column_signature", f"with {SQL_SIG} select dataset_id, column_signature from sig")
def column_signature(spark: SparkSession, sf: str) -> DataFrame:
    return matching.column_signature(customer_columns(spark, sf))


def segment_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """A saved profile per segment but MACHINERY: the first customer's confirmed mapping."""
    segments = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("k")).filter("c_mktsegment <> 'MACHINERY'")
    columns = segments.select(
        F.col("c_mktsegment").alias("dataset_id"), F.posexplode(F.array(F.lit("order key"), F.lit("quantity"), F.lower("c_mktsegment"), F.lit("unit"), F.lit("unit"))).alias("col_idx", "header")
    )
    entry = F.array(
        F.struct(F.lit("key").alias("target_field"), F.lit("order key").alias("source_column_normalised"), F.lit(0).alias("source_column_occurrence"), F.lit(None).cast("string").alias("inferred_value")),
        F.struct(F.lit("unit").alias("target_field"), F.lit("unit").alias("source_column_normalised"), F.lit(1).alias("source_column_occurrence"), F.lit(None).cast("string").alias("inferred_value")),
        F.struct(F.lit("lab").alias("target_field"), F.lit(None).cast("string").alias("source_column_normalised"), F.lit(0).alias("source_column_occurrence"), F.lit("north").alias("inferred_value")),
    )
    return matching.column_signature(columns).select(
        F.lit("fs").alias("field_set_signature"), "column_signature", F.col("dataset_id").alias("profile_id"), entry.alias("field_mappings"), F.concat(F.lit("vendor "), F.col("dataset_id")).alias("vendor")
    )


@query("profile_hits", f"with {SQL_SIG} select s.dataset_id, c.c_mktsegment as profile_id from sig s join customer c using (c_custkey) where c.c_mktsegment<>'MACHINERY'")
def profile_hits(spark: SparkSession, sf: str) -> DataFrame:
    signed = matching.column_signature(customer_columns(spark, sf)).withColumn("field_set_signature", F.lit("fs"))
    return matching.find_profiles(signed, segment_profiles(spark, sf)).select("dataset_id", "profile_id")


@query(
    "profile_replay",
    f"""with {SQL_CC} select dataset_id, f.target_field, case f.target_field when 'key' then case when cc.c_custkey%3=0 then 'ORDER   KEY ' else 'Order Key' end when 'unit' then case when cc.c_custkey%3=0 then ' Unit' else 'unit' end end as source_column,
      f.target_field='unit' as needs_confirmation, case when f.target_field='lab' then 'north' end as inferred_value
      from (select distinct c_custkey, dataset_id from cc) cc join customer c on c.c_custkey=cc.c_custkey cross join (select unnest(['key','unit','lab']) as target_field) f where c.c_mktsegment<>'MACHINERY'""",
)
def profile_replay(spark: SparkSession, sf: str) -> DataFrame:
    columns = customer_columns(spark, sf)
    signed = matching.column_signature(columns).withColumn("field_set_signature", F.lit("fs"))
    hits = matching.find_profiles(signed, segment_profiles(spark, sf))
    return matching.replay_profiles(hits, columns).select("dataset_id", "target_field", "source_column", "needs_confirmation", "inferred_value")


@query(
    "header_occurrence",
    f"with {SQL_CC} select dataset_id, col_idx, header, {NORM.format('header')} as norm, row_number() over (partition by dataset_id, {NORM.format('header')} order by col_idx)-1 as occurrence, count(*) over (partition by dataset_id, {NORM.format('header')}) as n_same from cc",
)
def header_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return matching.with_occurrence(matching.with_norm(customer_columns(spark, sf), "header"))


# ---- schema scores: brands as schemas, suppliers as datasets ----------------------------------


def brand_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct part type and name of a brand as a declared field."""
    part = table(spark, sf, "part")
    return part.groupBy(F.col("p_brand").alias("schema_name"), F.translate("p_name", " ", "_").alias("name")).agg(F.min("p_partkey").alias("pos"))


def part_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A dataset per supplier: its parts' names as headers, in part order."""
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    seen = li.select("l_suppkey", "l_partkey").distinct().join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return seen.groupBy("l_suppkey", "p_name").agg(F.min("p_partkey").cast("int").alias("col_idx")).select(
        F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("dataset_id"), "col_idx", F.upper("p_name").alias("header")
    )


SQL_SCORE = """bf as (select p_brand as schema_name, replace(p_name,' ','_') as name from part group by all),
  pc as (select 'supplier-'||cast(l_suppkey as varchar) as dataset_id, p_name, min(p_partkey) as col_idx from lineitem join part on l_partkey=p_partkey group by all),
  sc as (select dataset_id, schema_name, count(*) as matched from bf join pc on replace(bf.name,'_',' ')=pc.p_name group by all),
  tot as (select schema_name, count(*) as total from bf group by all),
  rk as (select dataset_id, schema_name, matched, total, matched/total as score, row_number() over (partition by dataset_id order by matched/total desc, schema_name) as rank from sc join tot using (schema_name))"""


@query("schema_scores", f"with {SQL_SCORE} select dataset_id, schema_name, 'crosswalk' as source, matched as n_matched, total-matched as n_uncovered, total, round(score,9) as score, rank from rk")
def schema_scores(spark: SparkSession, sf: str) -> DataFrame:
    fields = brand_fields(spark, sf)
    scored = matching.score_schemas(part_columns(spark, sf), fields, matching.alias_index(fields, None))
    return scored.select("dataset_id", "schema_name", "source", F.size("matched").alias("n_matched"), F.size("uncovered").alias("n_uncovered"), "total", F.round("score", 9).alias("score"), "rank")


@query(
    "schema_preselect",
    f"with {SQL_SCORE}, t as (select dataset_id, max(schema_name) filter (rank=1) as a, max(score) filter (rank=1) as s1, max(score) filter (rank=2) as s2 from rk group by all) select dataset_id, coalesce(s1=s2,false) as tie, case when coalesce(s1=s2,false) then null else a end as preselected from t",
)
def schema_preselect(spark: SparkSession, sf: str) -> DataFrame:
    fields = brand_fields(spark, sf)
    return matching.preselect(matching.score_schemas(part_columns(spark, sf), fields, matching.alias_index(fields, None)))


SQL_NEAR = f"""with hp as (select p_brand as dataset_id, case p_partkey%4 when 0 then substr(p_name,2,1)||substr(p_name,1,1)||substr(p_name,3) when 1 then substr(p_name,2) when 2 then p_name||'s' else p_name end as header from part),
  h as (select distinct dataset_id, header from hp), k as (select distinct p_type as schema_name, p_name as known from part),
  dist as (select needle, known, damerau_levenshtein(needle, known) as edits from (select distinct header as needle from h) join (select distinct known from k) on abs(length(needle)-length(known))<={NEAR_MAX_EDITS}),
  near as (select schema_name, needle, k.known, edits from dist join k using (known) where edits<=least({NEAR_MAX_EDITS}, floor(length(k.known)*{NEAR_MAX_RATIO})) and not exists (select 1 from k e where e.schema_name=k.schema_name and e.known=needle)),
  top as (select schema_name, needle, min(edits) as edits from near group by all),
  one as (select schema_name, needle, edits, min(known) as known from near join top using (schema_name, needle, edits) group by all having min(known)=max(known)),
  cov as (select distinct dataset_id, schema_name, known from h join k on known=header)
  select h.dataset_id, o.schema_name, h.header, o.known as field_name, o.known as resembles, cast(o.edits as int) as edits from one o join h on h.header=o.needle
  where not exists (select 1 from cov where cov.dataset_id=h.dataset_id and cov.schema_name=o.schema_name and cov.known=h.header) and not exists (select 1 from cov where cov.dataset_id=h.dataset_id and cov.schema_name=o.schema_name and cov.known=o.known)"""


@query("near_matches", SQL_NEAR)
def near_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Part names with two letters swapped, one lost or one added, against the brand's own names."""
    part = table(spark, sf, "part")
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    swapped = F.concat(F.substring(name, 2, 1), F.substring(name, 1, 1), F.substr(name, F.lit(3)))
    header = F.when(k == 0, swapped).when(k == 1, F.substr(name, F.lit(2))).when(k == 2, F.concat(name, F.lit("s"))).otherwise(name)
    columns = part.select(F.col("p_brand").alias("dataset_id"), F.col("p_partkey").cast("int").alias("col_idx"), header.alias("header"))
    fields = part.groupBy(F.col("p_type").alias("schema_name"), name.alias("name")).agg(F.min("p_partkey").alias("pos"))
    index = matching.alias_index(fields, None)
    return near.near_matches(columns, index, matching.covered_fields(columns, index))


# ---- vendors ----------------------------------------------------------------------------------


@query(
    "vendor_recall",
    """with seg as (select distinct s_nationkey as v, c_mktsegment as col from supplier join customer on s_nationkey=c_nationkey and c_custkey%20=s_suppkey%20),
      ds as (select 'customer-'||cast(c_custkey as varchar) as dataset_id, c_mktsegment as col, c_nationkey from customer),
      al as (select distinct 'vendor '||cast(v as varchar) as vendor, col||' '||cast(v%7 as varchar) as col from seg),
      f as (select dataset_id, list_sort(list(distinct vendor)) as vs from ds join al on al.col=ds.col||' '||cast(ds.c_nationkey as varchar) group by all)
      select ds.dataset_id, case when ds.c_nationkey=3 then 'known' when len(vs)=1 then vs[1] end as vendor, case when ds.c_nationkey=3 then 'profile' when len(vs)=1 then 'crosswalk' end as source,
        case when ds.c_nationkey<>3 and len(vs)>=2 then array_to_string(vs,',') else '' end as candidates from ds left join f using (dataset_id)""",
)
def vendor_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Vendors are nations with aliases on segment names; customers of one nation have a saved profile."""
    customer, supplier = table(spark, sf, "customer"), table(spark, sf, "supplier")
    asked = customer.select("c_nationkey", (F.col("c_custkey") % 20).alias("k"), "c_mktsegment").distinct()
    supplied = supplier.select("s_nationkey", (F.col("s_suppkey") % 20).alias("k")).distinct()
    pairs = supplied.join(asked, (F.col("s_nationkey") == F.col("c_nationkey")) & (supplied["k"] == asked["k"])).select("s_nationkey", "c_mktsegment").distinct()
    aliases = pairs.select(
        F.concat(F.lit("vendor "), F.col("s_nationkey").cast("string")).alias("vendor"), F.concat_ws(" ", F.col("c_mktsegment"), (F.col("s_nationkey") % 7).cast("string")).alias("source_column")
    )
    ident = F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("dataset_id")
    columns = customer.select(ident, F.posexplode(F.array(F.lit("x"), F.concat_ws(" ", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")))).alias("col_idx", "header"))
    learned = customer.filter("c_nationkey = 3").select(ident, F.lit("known").alias("vendor"))
    return matching.recall_vendor(columns, learned, aliases).withColumn("candidates", F.array_join("candidates", ","))


# ---- closures ---------------------------------------------------------------------------------


@query(
    "proposal_closure",
    """with w as (select 'order-'||cast(o_orderkey as varchar) as dataset_id, o_orderkey, unnest(['key','total','note']) as target_field, unnest([true,true,false]) as required from orders),
      p as (select dataset_id, target_field, case when o_orderkey%3=0 then 'ghost' when o_orderkey%3=1 then 'a' end as source_column, 0.7 as confidence from w where target_field<>'total' or o_orderkey%2=0)
      select w.dataset_id, w.target_field, p.source_column, coalesce(p.confidence,0.0)::double as confidence,
        case when not required and p.source_column is null then false when p.dataset_id is null or p.source_column='ghost' then true else false end as needs_confirmation
      from w left join p on p.dataset_id=w.dataset_id and p.target_field=w.target_field""",
)
def proposal_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Answers from outside for every order: some silent, some naming columns that are not there."""
    orders = table(spark, sf, "orders").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("dataset_id"), "o_orderkey")
    pair = lambda n, r: F.struct(F.lit(n).alias("target_field"), F.lit(r).alias("required"))
    wanted = orders.select("dataset_id", "o_orderkey", F.inline(F.array(pair("key", True), pair("total", True), pair("note", False))))
    columns = orders.select("dataset_id", F.posexplode(F.array(F.lit("a"), F.lit("b"))).alias("col_idx", "header"))
    k = F.col("o_orderkey") % 3
    answers = wanted.filter((F.col("target_field") != "total") | (F.col("o_orderkey") % 2 == 0)).select(
        "dataset_id", "target_field", F.when(k == 0, "ghost").when(k == 1, "a").alias("source_column"), F.lit(0.7).alias("confidence"), F.lit("r").alias("reasoning"),
        F.lit(False).alias("needs_confirmation"), F.lit(None).cast("string").alias("inferred_value"), F.array().cast("array<struct<source_column:string,confidence:double>>").alias("alternatives"),
    )
    # A second opinion that came first: the last answer is the one that counts.
    earlier = answers.filter((F.col("target_field") == "key") & F.col("dataset_id").rlike("[05]$")).withColumns({"source_column": F.lit("b"), "confidence": F.lit(0.9)})
    answers = answers.withColumn("position", F.lit(1)).unionByName(earlier.withColumn("position", F.lit(0)))
    return closures.close_proposals(answers, columns, wanted).select("dataset_id", "target_field", "source_column", "confidence", "needs_confirmation")


@query(
    "ranking_closure",
    """with r as (select 'user-'||cast(user_id as varchar) as dataset_id, event_id as position, event_type as schema_name, props as reason from events),
      k as (select dataset_id, schema_name, min(position) as position, arg_min(reason,position) as reason from r where schema_name<>'error' group by all)
      select dataset_id, schema_name, reason, row_number() over (partition by dataset_id order by position) as rank from k""",
)
def ranking_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Events as ranking answers of a user: unknown names drop, the first mention counts."""
    events = table(spark, sf, "events")
    rankings = events.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("dataset_id"), F.col("event_id").alias("position"), F.col("event_type").alias("schema_name"), F.col("props").alias("reason")
    )
    schemas = events.select(F.col("event_type").alias("schema_name")).distinct().filter("schema_name <> 'error'")
    return closures.close_rankings(rankings, schemas)


@query(
    "draft_closure",
    """with recursive d as (select 'order-'||cast(l_orderkey as varchar) as dataset_id, l_partkey*10000+l_suppkey as position, l_linenumber-2 as ci, case when l_quantity>45 then '' else l_returnflag||cast(cast(floor(l_quantity/5) as bigint) as varchar) end as name, l_linestatus as reason,
        row_number() over (partition by l_orderkey order by l_partkey*10000+l_suppkey, l_linenumber) as r from lineitem),
      f as (select distinct dataset_id, 0::bigint as r, []::bigint[] as cols, []::varchar[] as names, false as kept from d
        union all select d.dataset_id, d.r, case when ok then list_append(cols, ci::bigint) else cols end, case when ok then list_append(names, d.name) else names end, ok
        from (select d.*, f.cols, f.names, d.ci between 0 and 3 and d.name<>'' and not list_contains(f.cols, d.ci::bigint) and not list_contains(f.names, d.name) as ok from f join d on d.dataset_id=f.dataset_id and d.r=f.r+1) d)
      select dataset_id, position, ['a','b','c','d'][ci+1] as source_header, name, 'text' as type, true as required, reason from d join (select dataset_id, r from f where kept) using (dataset_id, r)""",
)
def draft_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as draft fields of their order: one ordered pass drops repeats and bad indexes."""
    li = table(spark, sf, "lineitem")
    ident = F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("dataset_id")
    drafts = li.select(
        ident, (F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("position"), (F.col("l_linenumber") - 2).cast("int").alias("column_index"),
        F.when(F.col("l_quantity") > 45, " ").otherwise(F.concat("l_returnflag", F.floor(F.col("l_quantity") / 5).cast("string"))).alias("name"), F.lit("text").alias("type"), F.lit(True).alias("required"), F.col("l_linestatus").alias("reason"),
    )
    columns = li.select(ident).distinct().select("dataset_id", F.posexplode(F.array(*[F.lit(h) for h in ("a", "b", "c", "d")])).alias("col_idx", "header"))
    return closures.close_drafts(drafts, columns)
