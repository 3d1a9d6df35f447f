"""Dictionary lifecycle and reconciliation, with the event log, parts and suppliers as edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Field, FieldSet, Tables
from ..operators import dictionary as d
from ..operators import reconcile as r
from ..operators.changes import Dictionary, apply_changes
from ..operators.matching import field_set_from_schema, vendor_alias_index
from ..plans import pipeline
from ..session import settle
from .registry import query, table

EPOCH = "2024-01-01 00:00:00"


def _null(kind: str):
    return F.lit(None).cast(kind)


def field_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as fields of their brand's schema; every ninth is tombstoned."""
    dead = F.col("p_partkey") % 9 == 0
    return table(spark, sf, "part").select(
        F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("field_id"), F.col("p_brand").alias("schema_id"), F.col("p_partkey").alias("seq"),
        F.concat_ws(" ", F.col("p_name"), F.col("p_partkey").cast("string")).alias("name"), _null("string").alias("description"), F.lit("number").alias("type"), _null("array<string>").alias("allowed_values"),
        F.col("p_type").alias("unit"), F.lit(True).alias("required"), F.col("p_size").cast("double").alias("min"), _null("double").alias("max"), _null("string").alias("date_format"),
        F.when(dead, F.lit(EPOCH).cast("timestamp")).alias("removed_at"), F.when(dead, "seed").alias("removed_by"),
    )


def alias_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as stored aliases: one per (part, supplier), the first by order; every seventh supplier's are tombstoned."""
    dead = F.col("l_suppkey") % 7 == 0
    li = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("seq"))
    return li.select(
        F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("field_id"), F.concat(F.lit("vendor "), F.col("l_suppkey").cast("string")).alias("vendor"), F.lit("col").alias("source_column"),
        F.lit("manual").alias("provenance_kind"), F.lit("seed").alias("provenance_actor"), F.lit(EPOCH).cast("timestamp").alias("created_at"), _null("double").alias("confidence"), _null("string").alias("note"),
        "seq", F.when(dead, F.lit(EPOCH).cast("timestamp")).alias("removed_at"), F.when(dead, "seed").alias("removed_by"),
    )


SQL_FIELDS = """fl as (select 'f'||cast(p_partkey as varchar) as field_id, p_partkey, p_brand as schema_id, p_name||' '||cast(p_partkey as varchar) as name, p_type as unit, p_size, case when p_partkey%9=0 then timestamp '2024-01-01' end as removed_at from part)"""
SQL_ALIASES = """al as (select 'f'||cast(l_partkey as varchar) as field_id, 'vendor '||cast(l_suppkey as varchar) as vendor, 'col' as source_column, 'seed' as actor, min(l_orderkey) as seq, case when l_suppkey%7=0 then timestamp '2024-01-01' end as removed_at from lineitem group by l_partkey, l_suppkey)"""
# Edits: every event asks for an alias of the part its user number and key point to.
SQL_EDITS = """ed as (select event_id, 'f'||cast(cast(json_extract(props,'$.k') as bigint)*20+user_id%20 as varchar) as field_id, 'vendor '||cast(user_id%100 as varchar) as vendor, case when event_type='click' then 'new' else 'col' end as source_column, 'user '||cast(user_id as varchar) as actor, ts from events)"""


def edits(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").select(
        F.concat(F.lit("f"), (k * 20 + F.col("user_id") % 20).cast("string")).alias("field_id"), F.concat(F.lit("vendor "), (F.col("user_id") % 100).cast("string")).alias("vendor"),
        F.when(F.col("event_type") == "click", "new").otherwise("col").alias("source_column"), F.lit("manual").alias("provenance_kind"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("provenance_actor"),
        F.col("ts").alias("created_at"), _null("double").alias("confidence"), _null("string").alias("note"), F.col("event_id").alias("seq"),
    )


_KEEP = ["field_id", "vendor", "source_column", "provenance_actor", "seq"]
SQL_FIRST = """fw as (select field_id, vendor, source_column, arg_min(actor, (ts, event_id)) as actor, arg_min(event_id, (ts, event_id)) as seq from ed where exists (select 1 from fl where fl.field_id=ed.field_id and fl.removed_at is null) group by all)"""


@query("alias_live", f"with {SQL_FIELDS}, {SQL_ALIASES} select field_id, vendor, source_column, actor as provenance_actor, seq from al where removed_at is null and exists (select 1 from fl where fl.field_id=al.field_id and fl.removed_at is null)")
def alias_live(spark: SparkSession, sf: str) -> DataFrame:
    return d.live_aliases(alias_rows(spark, sf), field_rows(spark, sf)).select(*_KEEP)


@query(
    "alias_first_write",
    f"""with {SQL_FIELDS}, {SQL_ALIASES}, {SQL_EDITS}, {SQL_FIRST} select field_id, vendor, source_column, actor as provenance_actor, seq, removed_at is not null as removed from al
      union all select field_id, vendor, source_column, actor, seq, false from fw where not exists (select 1 from al where al.removed_at is null and al.field_id=fw.field_id and al.vendor=fw.vendor and al.source_column=fw.source_column)""",
)
def alias_first_write(spark: SparkSession, sf: str) -> DataFrame:
    """Manual edits: live rows block, tombstoned ones do not."""
    after, _ = d.add_aliases(alias_rows(spark, sf), edits(spark, sf), field_rows(spark, sf))
    return after.select(*_KEEP, F.col("removed_at").isNotNull().alias("removed"))


@query("alias_errors", f"with {SQL_FIELDS}, {SQL_EDITS} select field_id, vendor, source_column, 'no live field of this id' as error from ed where not exists (select 1 from fl where fl.field_id=ed.field_id and fl.removed_at is null)")
def alias_errors(spark: SparkSession, sf: str) -> DataFrame:
    _, errors = d.add_aliases(alias_rows(spark, sf), edits(spark, sf), field_rows(spark, sf))
    return errors


@query(
    "alias_seed",
    f"""with {SQL_FIELDS}, {SQL_ALIASES}, {SQL_EDITS}, {SQL_FIRST} select field_id, vendor, source_column, actor as provenance_actor, seq from fw where not exists (select 1 from al where al.field_id=fw.field_id and al.vendor=fw.vendor and al.source_column=fw.source_column)""",
)
def alias_seed(spark: SparkSession, sf: str) -> DataFrame:
    """Seeding: tombstoned rows block as well."""
    _, inserted = d.seed_aliases(alias_rows(spark, sf), edits(spark, sf), field_rows(spark, sf))
    return inserted.select(*_KEEP)


@query(
    "alias_removal",
    f"""with {SQL_ALIASES}, rq as (select 'f'||cast(p_partkey as varchar) as field_id, 'vendor '||cast(p_partkey%50 as varchar) as vendor from part)
      select al.field_id, al.vendor, coalesce(al.removed_at, case when rq.field_id is not null then timestamp '2024-02-01' end) as removed_at from al left join rq on rq.field_id=al.field_id and rq.vendor=al.vendor""",
)
def alias_removal(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "part").select(
        F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("field_id"), F.concat(F.lit("vendor "), (F.col("p_partkey") % 50).cast("string")).alias("vendor"), F.lit("col").alias("source_column"),
        F.lit("admin").alias("actor"), F.lit("2024-02-01 00:00:00").cast("timestamp").alias("removed_at"),
    )
    after, _ = d.remove_aliases(alias_rows(spark, sf), requests)
    return after.select("field_id", "vendor", "removed_at")


@query(
    "field_removal",
    f"""with {SQL_FIELDS}, {SQL_ALIASES}, hit as (select field_id from fl where p_partkey%5=0 and removed_at is null)
      select 'field' as kind, field_id, '' as vendor, coalesce(removed_at, case when field_id in (select field_id from hit) then timestamp '2024-02-01' end) as removed_at from fl
      union all select 'alias', field_id, vendor, coalesce(removed_at, case when field_id in (select field_id from hit) then timestamp '2024-02-01' end) from al""",
)
def field_removal(spark: SparkSession, sf: str) -> DataFrame:
    """Removing a field stamps its live aliases with it."""
    fields, aliases = field_rows(spark, sf), alias_rows(spark, sf)
    requests = fields.filter(F.col("seq") % 5 == 0).select("schema_id", "name", F.lit("admin").alias("actor"), F.lit("2024-02-01 00:00:00").cast("timestamp").alias("removed_at"))
    after, stamped, _ = d.remove_fields(fields, aliases, requests)
    return after.select(F.lit("field").alias("kind"), "field_id", F.lit("").alias("vendor"), "removed_at").unionByName(stamped.select(F.lit("alias").alias("kind"), "field_id", "vendor", "removed_at"))


@query(
    "field_augment",
    f"""with {SQL_FIELDS}, inc as (select p_brand as schema_id, case when p_partkey%2=0 then p_name||' '||cast(p_partkey as varchar) else p_name end as name, p_partkey+100000000 as seq from part),
      fi as (select schema_id, name, min(seq) as seq from inc group by all)
      select schema_id, name, p_partkey as seq from fl union all select schema_id, name, seq from fi where not exists (select 1 from fl where fl.removed_at is null and fl.schema_id=fi.schema_id and fl.name=fi.name)""",
)
def field_augment(spark: SparkSession, sf: str) -> DataFrame:
    fields = field_rows(spark, sf)
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", F.col("p_name"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name"))
    incoming = table(spark, sf, "part").select(
        F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("field_id"), F.col("p_brand").alias("schema_id"), (F.col("p_partkey") + 100000000).alias("seq"), name.alias("name"), _null("string").alias("description"),
        F.lit("text").alias("type"), _null("array<string>").alias("allowed_values"), _null("string").alias("unit"), F.lit(True).alias("required"), _null("double").alias("min"), _null("double").alias("max"), _null("string").alias("date_format"),
    )
    return d.augment_fields(fields, incoming).select("schema_id", "name", "seq")


@query(
    "field_update",
    f"with {SQL_FIELDS} select field_id, case when removed_at is null and p_partkey%3=0 then upper(name) else name end as name, case when removed_at is null and p_partkey%3=0 then 'integer' else 'number' end as type from fl",
)
def field_update(spark: SparkSession, sf: str) -> DataFrame:
    fields = field_rows(spark, sf)
    changes = fields.filter(F.col("seq") % 3 == 0).select(
        "schema_id", F.col("name").alias("old_name"), F.upper("name").alias("name"), "description", F.lit("integer").alias("type"), "allowed_values", "unit", "required", "min", "max", "date_format"
    )
    after, _ = d.update_fields(fields, changes)
    return after.select("field_id", "name", "type")


@query("field_set_live", f"with {SQL_FIELDS} select schema_id as schema_name, row_number() over (partition by schema_id order by p_partkey)-1 as pos, name from fl where removed_at is null")
def field_set_live(spark: SparkSession, sf: str) -> DataFrame:
    return field_set_from_schema(field_rows(spark, sf).withColumnRenamed("schema_id", "schema_name")).select("schema_name", "pos", "name")


@query("field_cap", f"with {SQL_FIELDS}, n as (select schema_id, count(*) filter (removed_at is null) as n from fl group by all) select schema_id, 'extra' as name, 'the schema already has 50 fields' as error from n where n>=50")
def field_cap(spark: SparkSession, sf: str) -> DataFrame:
    fields = field_rows(spark, sf)
    one = fields.select("schema_id").distinct().select(
        F.lit("x").alias("field_id"), "schema_id", F.lit(1).cast("bigint").alias("seq"), F.lit("extra").alias("name"), _null("string").alias("description"), F.lit("text").alias("type"), _null("array<string>").alias("allowed_values"),
        _null("string").alias("unit"), F.lit(True).alias("required"), _null("double").alias("min"), _null("double").alias("max"), _null("string").alias("date_format"),
    )
    _, errors = d.add_field(fields, one)
    return errors


@query(
    "profile_last_write",
    """select 'u'||cast(user_id as varchar) as field_set_signature, event_type as column_signature, arg_max('p'||cast(event_id as varchar), (ts, -event_id)) as profile_id, max(ts) as created_at from events group by user_id, event_type""",
)
def profile_last_write(spark: SparkSession, sf: str) -> DataFrame:
    """Events as profile saves: the last write of a signature pair stays."""
    incoming = table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("field_set_signature"), F.col("event_type").alias("column_signature"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("profile_id"),
        F.array().cast("array<struct<target_field:string,source_column_normalised:string,source_column_occurrence:int,inferred_value:string>>").alias("field_mappings"),
        F.lit(None).cast(d.HINT).alias("structural_hint"), _null("string").alias("vendor"), F.col("ts").alias("created_at"),
    )
    stored = spark.createDataFrame([], d.PROFILES)
    return d.upsert_profiles(stored, incoming).select("field_set_signature", "column_signature", "profile_id", "created_at")


@query("template_last_write", "select 'set '||cast(user_id%40 as varchar) as name, max(ts) as created_at from events group by 1")
def template_last_write(spark: SparkSession, sf: str) -> DataFrame:
    incoming = table(spark, sf, "events").select(F.concat(F.lit("set "), (F.col("user_id") % 40).cast("string")).alias("name"), F.col("props").alias("fields"), F.col("ts").alias("created_at"))
    return d.upsert_templates(spark.createDataFrame([], "name string, fields string, created_at timestamp"), incoming).select("name", "created_at")


def schema_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as stored schemas; every fourth number is removed."""
    dead = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int") % 4 == 0
    return table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("seq")).select(
        F.col("p_brand").alias("schema_id"), F.col("p_brand").alias("schema_name"), F.lit("seed").alias("created_by"), F.lit(EPOCH).cast("timestamp").alias("created_at"), "seq",
        F.when(dead, F.lit(EPOCH).cast("timestamp")).alias("removed_at"), F.when(dead, "seed").alias("removed_by"),
    )


SQL_SCHEMAS = """sc as (select p_brand as schema_name, cast(p_brand[7:] as int)%4=0 as dead, min(p_partkey) as seq from part group by all)"""


@query(
    "schema_promote",
    f"""with {SQL_SCHEMAS}, rq as (select case when p_partkey%3=0 then null else p_brand end as name, case when p_partkey%2=0 then p_type end as set_name, p_partkey as seq from part),
      nm as (select coalesce(name,set_name) as schema_name, seq from rq where coalesce(name,set_name) is not null), f as (select schema_name, min(seq) as seq from nm group by all)
      select schema_name, seq from f where not exists (select 1 from sc where not dead and sc.schema_name=f.schema_name)""",
)
def schema_promote(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("set_name"), F.lit("me").alias("created_by"),
        F.lit(EPOCH).cast("timestamp").alias("created_at"), F.col("p_partkey").alias("seq"),
    )
    _, created, _ = d.promote(schema_rows(spark, sf), requests)
    return created.select("schema_name", "seq")


@query(
    "schema_rename",
    f"""with {SQL_SCHEMAS} select case when not dead and cast(schema_name[7:] as int)%3=1 then 'new '||schema_name else schema_name end as schema_name, dead as removed from sc""",
)
def schema_rename(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the brands ask for a new name, a third for a blank one."""
    k = F.regexp_extract("schema_name", "([0-9]+)", 1).cast("int") % 3
    schemas = schema_rows(spark, sf)
    requests = schemas.filter(k != 0).select("schema_name", F.when(k == 1, F.concat(F.lit("new "), F.col("schema_name"))).otherwise(" ").alias("new_name"))
    after, _ = d.rename_schemas(schemas, requests)
    return after.select("schema_name", F.col("removed_at").isNotNull().alias("removed"))


@query("schema_removal", f"with {SQL_SCHEMAS} select schema_name, case when dead then timestamp '2024-01-01' when cast(schema_name[7:] as int)%2=1 then timestamp '2024-03-01' end as removed_at from sc")
def schema_removal(spark: SparkSession, sf: str) -> DataFrame:
    schemas = schema_rows(spark, sf)
    odd = F.regexp_extract("schema_name", "([0-9]+)", 1).cast("int")
    requests = schemas.filter((odd % 2 == 1) | (odd % 4 == 0)).select("schema_name", F.lit("admin").alias("actor"), F.lit("2024-03-01 00:00:00").cast("timestamp").alias("removed_at"))
    return d.remove_schemas(schemas, requests).select("schema_name", "removed_at")


@query(
    "confirmed_aliases",
    f"""with {SQL_FIELDS}, cf as (select c_custkey, 'vendor '||cast(c_nationkey as varchar) as vendor, f.schema_id, f.name, f.field_id, f.removed_at from customer join fl f on f.p_partkey=c_custkey)
      select field_id, vendor, 'col '||name as source_column, 'user '||cast(c_custkey as varchar) as provenance_actor, c_custkey as seq from cf where removed_at is null and c_custkey%5<>0""",
)
def confirmed_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Customers confirm one field each; inferred-only fields and blank vendors leave no alias."""
    fields = field_rows(spark, sf)
    confirmed = table(spark, sf, "customer").join(fields, F.col("seq") == F.col("c_custkey")).select(
        "schema_id", F.when(F.col("c_custkey") % 10 == 5, " ").otherwise(F.concat(F.lit("vendor "), F.col("c_nationkey").cast("string"))).alias("vendor"), F.concat(F.lit("user "), F.col("c_custkey").cast("string")).alias("actor"),
        F.lit(EPOCH).cast("timestamp").alias("created_at"), F.col("c_custkey").alias("seq"), F.col("name").alias("target_field"), F.when(F.col("c_custkey") % 10 != 0, F.concat(F.lit("col "), F.col("name"))).alias("source_column"),
    )
    after, _ = d.record_aliases(spark.createDataFrame([], d.ALIASES), fields, confirmed)
    return after.select(*_KEEP)


@query("vendor_list", f"with {SQL_FIELDS}, {SQL_ALIASES} select distinct vendor from al where removed_at is null and exists (select 1 from fl where fl.field_id=al.field_id and fl.removed_at is null)")
def vendor_list(spark: SparkSession, sf: str) -> DataFrame:
    return d.list_vendors(alias_rows(spark, sf), field_rows(spark, sf))


@query(
    "master_map_round_trip",
    f"""with {SQL_FIELDS}, {SQL_ALIASES}, {SQL_SCHEMAS} select fl.schema_id as schema_name, row_number() over (partition by fl.schema_id order by p_partkey)-1 as pos, name, unit, cast(p_size as double) as min, (select count(*) from al where al.field_id=fl.field_id and al.removed_at is null) as n_aliases
      from fl join sc on sc.schema_name=fl.schema_id where not dead and removed_at is null""",
)
def master_map_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Schemas exported as JSON envelopes and read back."""
    maps = d.export_master_map(schema_rows(spark, sf), field_rows(spark, sf), alias_rows(spark, sf))
    fields, _ = d.read_master_maps(maps.select(F.col("schema_name").alias("map_id"), "envelope"))
    return fields.select("schema_name", "pos", "name", "unit", "min", F.size("aliases").cast("bigint").alias("n_aliases"))


# ---- reconcile --------------------------------------------------------------------------------


def dictionaries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two dictionaries over (supplier, part name): the master says the part's type, the map file disagrees on some."""
    part = table(spark, sf, "part")
    pairs = settle(table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_name").agg(F.min("p_partkey").alias("seq"), F.min_by("p_type", "p_partkey").alias("kind")))
    vendor = F.concat(F.lit("vendor "), F.col("l_suppkey").cast("string")).alias("vendor")
    master = pairs.filter(F.col("seq") % 5 != 0).select(F.lit("s").alias("schema_name"), vendor, F.col("p_name").alias("source_column"), F.col("kind").alias("field_name"), F.lit(0).cast("bigint").alias("field_seq"), "seq")
    incoming = pairs.filter(F.col("seq") % 7 != 0).select(
        F.lit("s").alias("schema_name"), vendor, F.upper("p_name").alias("source_column"), F.when(F.col("seq") % 3 == 0, "OTHER").otherwise(F.col("kind")).alias("field_name"), F.lit(0).cast("bigint").alias("field_seq"), "seq"
    )
    return master, incoming


SQL_PAIRS = """pr as (select 'vendor '||cast(l_suppkey as varchar) as vendor, p_name, min(p_partkey) as seq, arg_min(p_type,p_partkey) as kind from lineitem join part on l_partkey=p_partkey group by all),
  cf as (select vendor, upper(p_name) as source_column, p_name as norm, kind as master_field, 'OTHER' as map_file_field, seq from pr where seq%5<>0 and seq%7<>0 and seq%3=0)"""


@query("reconcile_conflicts", f"with {SQL_PAIRS} select vendor, source_column, norm, master_field, map_file_field from cf")
def reconcile_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    master, incoming = dictionaries(spark, sf)
    return r.detect_conflicts(incoming, master)


def choices(master: DataFrame) -> DataFrame:
    return master.filter(F.col("seq") % 2 == 0).select("vendor", F.concat(F.lit("  "), F.col("source_column")).alias("source_column"), F.when(F.col("seq") % 4 == 0, "take_map_file").otherwise("keep_master").alias("decision"))


@query("reconcile_undecided", f"with {SQL_PAIRS} select vendor, source_column, norm, master_field, map_file_field from cf where seq%2=1")
def reconcile_undecided(spark: SparkSession, sf: str) -> DataFrame:
    master, incoming = dictionaries(spark, sf)
    return r.undecided(r.detect_conflicts(incoming, master), choices(master))


@query(
    "reconcile_overrides",
    f"""with {SQL_PAIRS} select vendor, p_name as norm, case when seq%4=0 then case when seq%3=0 then 'OTHER' else kind end else kind end as field_name from pr where seq%5<>0 and seq%2=0 and not (seq%4=0 and seq%7=0)""",
)
def reconcile_overrides(spark: SparkSession, sf: str) -> DataFrame:
    master, incoming = dictionaries(spark, sf)
    return r.override_index(choices(master), master, incoming)


@query(
    "reconcile_mapping",
    f"""with {SQL_PAIRS}, ix as (select vendor, p_name, seq, case when seq%4=0 and seq%7<>0 and seq%3=0 then 'OTHER' else kind end as kind from pr where seq%5<>0),
      hit as (select vendor, kind, arg_min(p_name, seq) as p_name from ix group by all)
      select replace(vendor,'vendor ','supplier-') as dataset_id, kind as target_field, p_name as source_column, 1.0::double as confidence, false as needs_confirmation from hit""",
)
def reconcile_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's part names as headers, mapped by that vendor's own aliases onto every field of both dictionaries, decisions first."""
    master, incoming = dictionaries(spark, sf)
    ident = F.regexp_replace("vendor", "vendor ", "supplier-")
    columns = master.select(ident.alias("dataset_id"), F.col("seq").cast("int").alias("col_idx"), F.col("source_column").alias("header"))
    vendors = master.select(ident.alias("dataset_id"), "vendor").distinct()
    fields = master.unionByName(incoming).groupBy("schema_name", F.col("field_name").alias("target_field")).agg(F.lit(True).alias("required"))
    targets = vendors.withColumn("schema_name", F.lit("s")).join(fields, "schema_name").select("dataset_id", "target_field", "required")
    mappings, _ = r.reconcile_map(columns, targets, vendor_alias_index(master), r.override_index(choices(master), master, incoming), vendors)
    return mappings.select("dataset_id", "target_field", "source_column", "confidence", "needs_confirmation")


TYPES = FieldSet("s", tuple(Field(n, "text") for n in ("ECONOMY", "LARGE", "MEDIUM", "OTHER", "PROMO", "SMALL", "STANDARD")))


@query(
    "reconcile_plan",
    f"""with {SQL_PAIRS}, held as (select distinct vendor from cf where cast(substr(vendor,8) as int)%2=1), free as (select distinct vendor from pr where vendor not in (select vendor from held)),
      ix as (select vendor, p_name, seq, case when seq%5<>0 then case when seq%4=0 and seq%7<>0 and seq%3=0 then 'OTHER' else kind end when seq%3=0 then 'OTHER' else kind end as kind from pr where seq%5<>0 or seq%7<>0),
      hit as (select vendor, kind, arg_min(p_name, seq) as p_name from ix group by all), f as (select unnest(['ECONOMY','LARGE','MEDIUM','OTHER','PROMO','SMALL','STANDARD']) as kind)
      select replace(free.vendor,'vendor ','supplier-') as dataset_id, f.kind as target_field, p_name as source_column, p_name is null as needs_confirmation from free cross join f left join hit on hit.vendor=free.vendor and hit.kind=f.kind""",
)
def reconcile_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Two dictionaries reconciled: vendors with an open conflict stay unmapped, the others are mapped by master, map file and decisions."""
    master, incoming = dictionaries(spark, sf)
    ident = F.regexp_replace("vendor", "vendor ", "supplier-").alias("dataset_id")
    part = table(spark, sf, "part")
    pairs = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_name").agg(F.min("p_partkey").alias("seq"))
    named = settle(pairs.select(F.concat(F.lit("vendor "), F.col("l_suppkey").cast("string")).alias("vendor"), "p_name", "seq"))
    columns = named.select(ident, F.col("seq").cast("int").alias("col_idx"), F.col("p_name").alias("header"))
    vendors = named.select(ident, "vendor").distinct()
    ids = vendors.select("dataset_id")
    datasets = ids.select("dataset_id", F.col("dataset_id").alias("source_file"), F.col("dataset_id").alias("sheet"), F.lit(0).alias("table_idx"), F.col("dataset_id").alias("origin_sheet"), F.lit(None).cast("string").alias("label"))
    rows = ids.select("dataset_id", F.lit(0).cast("bigint").alias("row_idx"), F.array(F.lit("x")).alias("cells"))
    even = F.regexp_extract("vendor", "([0-9]+)$", 1).cast("bigint") % 2 == 0
    decided = master.filter(even).select("vendor", "source_column", F.when(F.col("seq") % 4 == 0, "take_map_file").otherwise("keep_master").alias("decision"))
    done = pipeline.reconcile(Tables(datasets, columns, rows), TYPES, master, incoming, vendors, decided)
    return done.mappings.select("dataset_id", "target_field", "source_column", "needs_confirmation")


# ---- reconcile with import ----------------------------------------------------------------------

IMPORTED_AT = "2024-06-01 00:00:00"


def import_case(spark: SparkSession, sf: str) -> tuple[Tables, Dictionary, DataFrame, DataFrame, DataFrame]:
    """(tables, dictionary, map files, vendors, choices): each vendor brings a map file of its own; even vendors' conflicts are decided."""
    master, incoming = dictionaries(spark, sf)
    at, none = F.lit("2024-01-01").cast("timestamp"), F.lit(None).cast("string")
    removed = [F.lit(None).cast("timestamp").alias("removed_at"), none.alias("removed_by")]
    schemas = spark.range(1).select(F.lit("s").alias("schema_id"), F.lit("s").alias("schema_name"), F.lit("user").alias("created_by"), at.alias("created_at"), F.lit(0).cast("bigint").alias("seq"), *removed)
    kinds = [f.name for f in TYPES.fields if f.name != "OTHER"]
    fields = spark.range(1).select(F.posexplode(F.array(*map(F.lit, kinds))).alias("seq", "name")).select(
        F.concat(F.lit("f-"), F.col("name")).alias("field_id"), F.lit("s").alias("schema_id"), F.col("seq").cast("bigint").alias("seq"), "name", none.alias("description"), F.lit("text").alias("type"),
        F.lit(None).cast("array<string>").alias("allowed_values"), none.alias("unit"), F.lit(True).alias("required"), F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"),
        none.alias("date_format"), *removed,
    )
    aliases = master.select(
        F.concat(F.lit("f-"), F.col("field_name")).alias("field_id"), "vendor", "source_column", F.lit("confirmed").alias("provenance_kind"), F.lit("user").alias("provenance_actor"), at.alias("created_at"),
        F.lit(None).cast("double").alias("confidence"), none.alias("note"), "seq", *removed,
    )
    spelled = F.struct("vendor", "source_column", F.lit("map").alias("provenance_actor"))
    per_field = incoming.groupBy("vendor", F.col("field_name").alias("name")).agg(F.sort_array(F.collect_list(spelled)).alias("aliases"))
    maps = per_field.groupBy(F.col("vendor").alias("map_id")).agg(F.sort_array(F.collect_list(F.struct("name", F.lit("text").alias("type"), "aliases"))).alias("fields"))
    envelopes = settle(maps.select("map_id", F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("s").alias("name"), "fields")).alias("envelope")))
    pairs = settle(master.select("vendor", "source_column", "seq").unionByName(incoming.select("vendor", F.lower("source_column").alias("source_column"), "seq")).distinct())
    ident = F.regexp_replace("vendor", "vendor ", "supplier-").alias("dataset_id")
    vendors = pairs.select(ident, "vendor").distinct()
    columns = pairs.select(ident, F.col("seq").cast("int").alias("col_idx"), F.col("source_column").alias("header"))
    ids = vendors.select("dataset_id")
    datasets = ids.select("dataset_id", F.col("dataset_id").alias("source_file"), F.col("dataset_id").alias("sheet"), F.lit(0).alias("table_idx"), F.col("dataset_id").alias("origin_sheet"), none.alias("label"))
    rows = ids.select("dataset_id", F.lit(0).cast("bigint").alias("row_idx"), F.array(F.lit("x")).alias("cells"))
    even = F.regexp_extract("vendor", "([0-9]+)$", 1).cast("bigint") % 2 == 0
    decided = master.filter(even).select("vendor", "source_column", F.when(F.col("seq") % 4 == 0, "take_map_file").otherwise("keep_master").alias("decision"))
    return Tables(datasets, columns, rows), Dictionary(schemas, fields, aliases), envelopes, vendors, decided


SQL_IMPORT = f"""with {SQL_PAIRS}, held as (select distinct vendor from cf where cast(substr(vendor,8) as int)%2=1), vs as (select distinct vendor, vendor in (select vendor from held) as is_held from pr where seq%5<>0 or seq%7<>0),
  mp as (select pr.*, is_held, seq%5<>0 as ours, seq%7<>0 as theirs, case when seq%3=0 then 'OTHER' else kind end as their_kind from pr join vs using (vendor) where seq%5<>0 or seq%7<>0)"""


@query("reconcile_changes", f"""{SQL_IMPORT}
  select 'aliases' as table_name, 'keep' as op, count(*) as n, 'confirmed' as provenance from mp where ours
  union all select 'aliases', 'insert', count(*), 'from_map_file' from mp where theirs and not is_held
  union all select 'fields', 'keep', 6, null union all select 'fields', 'insert', 1, null from (select 1 where exists (select 1 from mp where theirs and not is_held and their_kind='OTHER'))
  union all select 'schemas', 'keep', 1, null""")
def reconcile_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What importing all vendors' map files does to the dictionary, as one changeset."""
    tables, dictionary, envelopes, vendors, decided = import_case(spark, sf)
    done = pipeline.reconcile_import(tables, TYPES, dictionary, "s", envelopes, vendors, F.lit(IMPORTED_AT).cast("timestamp"), decided)
    return done.changes.groupBy("table_name", "op", F.col("alias_row.provenance_kind").alias("provenance")).agg(F.count("*").alias("n"))


@query("reconcile_import", f"""{SQL_IMPORT},
  first as (select vendor, p_name, seq, case when ours then case when theirs and seq%4=0 and seq%3=0 then 'OTHER' else kind end else their_kind end as kind from mp where not is_held),
  second as (select vendor, p_name, seq, case when theirs and not is_held and seq%3=0 then 'OTHER' else kind end as kind from mp where ours or not is_held),
  hits as (select 1 as run, vendor, kind, arg_min(p_name, seq) as p_name from first group by all union all select 2, vendor, kind, arg_min(p_name, seq) from second group by all)
  select run, replace(vendor,'vendor ','supplier-') as dataset_id, kind as target_field, p_name as source_column, 'reconciled-from-crosswalk' as provenance from hits""")
def reconcile_import(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs: the first reconciles and imports, the second, without map files or decisions, sees the imported aliases."""
    tables, dictionary, envelopes, vendors, decided = import_case(spark, sf)
    at = F.lit(IMPORTED_AT).cast("timestamp")
    first = pipeline.reconcile_import(tables, TYPES, dictionary, "s", envelopes, vendors, at, decided)
    merged = Dictionary(*(settle(t) for t in apply_changes(dictionary, first.changes)))
    second = pipeline.reconcile_import(tables, TYPES, merged, "s", envelopes.limit(0), vendors, at)
    runs = [done.mappings.join(done.provenance, "dataset_id").withColumn("run", F.lit(k)) for k, done in ((1, first), (2, second))]
    return runs[0].unionByName(runs[1]).filter(F.col("source_column").isNotNull()).select("run", "dataset_id", "target_field", "source_column", "provenance")
