"""Governed dictionary tables: schemas, fields, aliases, profiles, templates.

Every write is a pure function from the current tables and incoming rows to the next version
plus error rows. Nothing is deleted: removal stamps a tombstone. Duplicates inside a batch
are settled by a mergeable minimum, so a key repeated in a third of the log is no hot task.

* schemas   schema_id, schema_name, created_by, created_at, seq, removed_at, removed_by
* fields    field_id, schema_id, seq, name, description, type, allowed_values, unit, required,
            min, max, date_format, removed_at, removed_by
* aliases   field_id, vendor, source_column, provenance_kind, provenance_actor, created_at,
            confidence, note, seq, removed_at, removed_by
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..model import HINT, MAX_FIELDS
from ..session import settle
from .common import BLOCK_ROWS, first_per_key
from .matching import stored_mapping

SCHEMAS = "schema_id string, schema_name string, created_by string, created_at timestamp, seq bigint, removed_at timestamp, removed_by string"
FIELDS = (
    "field_id string, schema_id string, seq bigint, name string, description string, type string, allowed_values array<string>, "
    "unit string, required boolean, min double, max double, date_format string, removed_at timestamp, removed_by string"
)
ALIASES = (
    "field_id string, vendor string, source_column string, provenance_kind string, provenance_actor string, created_at timestamp, "
    "confidence double, note string, seq bigint, removed_at timestamp, removed_by string"
)
PROFILES = (
    "field_set_signature string, column_signature string, profile_id string, field_mappings "
    "array<struct<target_field:string,source_column_normalised:string,source_column_occurrence:int,inferred_value:string>>, "
    f"structural_hint {HINT}, vendor string, created_at timestamp"
)
ALIAS_KEY = ["field_id", "vendor", "source_column"]


def _is_live() -> Column:
    return F.col("removed_at").isNull()


def live(table: DataFrame) -> DataFrame:
    """G1 for schemas and fields: rows without a tombstone."""
    return table.filter(_is_live())


def live_aliases(aliases: DataFrame, fields: DataFrame) -> DataFrame:
    """G1 for aliases: live rows of live fields."""
    return aliases.filter(_is_live()).join(live(fields).select("field_id"), "field_id", "left_semi")


def alias_view(schemas: DataFrame, fields: DataFrame, aliases: DataFrame) -> DataFrame:
    """Live aliases with their field and schema names, as the matching operators take them."""
    named = live(fields).select("field_id", "schema_id", F.col("name").alias("field_name"), F.col("seq").alias("field_seq"))
    return (
        aliases.filter(_is_live()).join(named, "field_id")
        .join(live(schemas).select("schema_id", "schema_name"), "schema_id")
        .select("schema_name", "field_id", "field_name", "field_seq", "vendor", "source_column", "seq")
    )


def schema_id(name: Column, created_at: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", name, created_at.cast("string")), 256)


def field_id(schema: Column, name: Column, created_at: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", schema, name, created_at.cast("string")), 256)


def promote(schemas: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(schemas, created, errors). requests: name, set_name, created_by, created_at, seq.

    The name comes from the request, else from the field set; a nameless request or a live name errs.
    """
    named = requests.withColumn("schema_name", F.coalesce(F.nullif(strip(F.col("name")), F.lit("")), F.nullif(strip(F.col("set_name")), F.lit(""))))
    nameless = named.filter(F.col("schema_name").isNull()).select("schema_name", F.lit("a schema needs a name").alias("error"))
    asked = first_per_key(named.filter(F.col("schema_name").isNotNull()), ["schema_name"], ["created_at", "seq"])
    taken = asked.join(live(schemas).select("schema_name"), "schema_name", "left_semi").select(
        "schema_name", F.lit("a schema of this name exists").alias("error")
    )
    created = asked.join(live(schemas).select("schema_name"), "schema_name", "left_anti").select(
        schema_id(F.col("schema_name"), F.col("created_at")).alias("schema_id"), "schema_name", "created_by", "created_at", "seq",
        F.lit(None).cast("timestamp").alias("removed_at"), F.lit(None).cast("string").alias("removed_by"),
    )
    return schemas.unionByName(created), created, nameless.unionByName(taken)


def augment_fields(fields: DataFrame, incoming: DataFrame) -> DataFrame:
    """Adds fields whose name no live field of the schema has; nothing is overwritten.

    incoming: the fields columns without tombstones, `created_at` optional.
    """
    stamped = incoming.withColumn("removed_at", F.lit(None).cast("timestamp")).withColumn("removed_by", F.lit(None).cast("string"))
    fresh = first_per_key(stamped.select(*fields.columns), ["schema_id", "name"], ["seq"])
    return fields.unionByName(fresh.join(live(fields).select("schema_id", "name"), ["schema_id", "name"], "left_anti"))


def _stamped(aliases: DataFrame, incoming: DataFrame) -> DataFrame:
    return incoming.withColumn("removed_at", F.lit(None).cast("timestamp")).withColumn("removed_by", F.lit(None).cast("string")).select(*aliases.columns)


def add_aliases(aliases: DataFrame, incoming: DataFrame, fields: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(aliases, errors). The first write of (field, vendor, source_column) keeps its provenance.

    Only live rows block, so an alias may come back after its removal. A missing field is an error row.
    """
    errors = None
    if fields is not None:
        known = live(fields).select("field_id")
        errors = incoming.join(known, "field_id", "left_anti").select(*ALIAS_KEY, F.lit("no live field of this id").alias("error"))
        incoming = incoming.join(known, "field_id", "left_semi")
    first = first_per_key(_stamped(aliases, incoming), ALIAS_KEY, ["created_at", "seq"])
    fresh = first.join(aliases.filter(_is_live()).select(*ALIAS_KEY), ALIAS_KEY, "left_anti")
    if errors is None:
        errors = incoming.select(*ALIAS_KEY, F.lit(None).cast("string").alias("error")).filter(F.lit(False))
    return aliases.unionByName(fresh), errors


def seed_aliases(aliases: DataFrame, incoming: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, inserted). Tombstoned rows block too, and a missing field is skipped in silence."""
    wanted = incoming.join(live(fields).select("field_id"), "field_id", "left_semi")
    first = first_per_key(_stamped(aliases, wanted), ALIAS_KEY, ["created_at", "seq"])
    fresh = first.join(aliases.select(*ALIAS_KEY).distinct(), ALIAS_KEY, "left_anti")
    return aliases.unionByName(fresh), fresh


FIELD_ATTRIBUTES = ("name", "description", "type", "allowed_values", "unit", "required", "min", "max", "date_format")


def update_fields(fields: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, errors). changes: schema_id, old_name, and the full new declaration; ids stay."""
    renamed = changes.select(F.col("schema_id"), F.col("old_name").alias("name"), F.struct(*[F.col(c) for c in FIELD_ATTRIBUTES]).alias("_new"))
    joined = fields.join(renamed.withColumn("_hit", F.lit(True)), ["schema_id", "name"], "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & _is_live()
    updated = joined.select(*[
        F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in FIELD_ATTRIBUTES else F.col(c) for c in fields.columns
    ])
    errors = renamed.join(live(fields).select("schema_id", "name"), ["schema_id", "name"], "left_anti").select(
        "schema_id", "name", F.lit("no live field of this name").alias("error")
    )
    return updated, errors


def remove_fields(fields: DataFrame, aliases: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fields, aliases, errors). requests: schema_id, name, actor, removed_at.

    The field and its live aliases get the same stamp. No actor, or no live field, is an error row.
    """
    actor = F.coalesce(strip(F.col("actor")), F.lit("")) != ""
    asked = first_per_key(
        requests.filter(actor).select("schema_id", "name", F.col("removed_at").alias("_at"), F.col("actor").alias("_by")), ["schema_id", "name"], ["_at"]
    )
    targets = live(fields).select("field_id", "schema_id", "name").join(asked, ["schema_id", "name"]).select("field_id", "_at", "_by")
    errors = requests.filter(~actor).select("schema_id", "name", F.lit("an actor is required").alias("error")).unionByName(
        asked.join(live(fields).select("schema_id", "name"), ["schema_id", "name"], "left_anti").select("schema_id", "name", F.lit("no live field of this name").alias("error"))
    )
    return _entomb(fields, targets, ["field_id"]), _entomb(aliases, targets, ["field_id"]), errors


def _entomb(table: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Live rows matched by `targets` (keys, _at, _by) get its stamp; everything else is unchanged."""
    joined = table.join(targets, keys, "left")
    stamp = _is_live() & F.col("_at").isNotNull()
    return joined.select(*[
        F.when(stamp, F.col("_at")).otherwise(F.col(c)).alias(c) if c == "removed_at"
        else F.when(stamp, F.col("_by")).otherwise(F.col(c)).alias(c) if c == "removed_by"
        else F.col(c)
        for c in table.columns
    ])


def remove_aliases(aliases: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, errors). requests: the alias key, actor, removed_at."""
    asked = first_per_key(
        requests.select(*ALIAS_KEY, F.col("removed_at").alias("_at"), F.col("actor").alias("_by")), ALIAS_KEY, ["_at"]
    )
    errors = asked.join(aliases.filter(_is_live()).select(*ALIAS_KEY), ALIAS_KEY, "left_anti").select(*ALIAS_KEY, F.lit("no live alias matches").alias("error"))
    return _entomb(aliases, asked, ALIAS_KEY), errors


def remove_schemas(schemas: DataFrame, requests: DataFrame) -> DataFrame:
    """Idempotent; the first stamp stays, and fields are not touched."""
    asked = first_per_key(
        requests.select("schema_name", F.col("removed_at").alias("_at"), F.col("actor").alias("_by")), ["schema_name"], ["_at"]
    )
    return _entomb(schemas, asked, ["schema_name"])


def rename_schemas(schemas: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(schemas, errors). requests: schema_name, new_name. Blank or live-taken names are refused."""
    wish = requests.withColumn("new_name", strip(F.col("new_name")))
    taken = live(schemas).select(F.col("schema_name").alias("new_name")).withColumn("_taken", F.lit(True))
    known = live(schemas).select("schema_name").withColumn("_known", F.lit(True))
    judged = wish.join(known, "schema_name", "left").join(taken, "new_name", "left")
    error = (
        F.when(F.col("_known").isNull(), "no live schema of this name")
        .when(F.coalesce("new_name", F.lit("")) == "", "the new name is blank")
        .when(F.col("_taken") & (F.col("new_name") != F.col("schema_name")), "the new name is taken")
    )
    settled = judged.select("schema_name", "new_name", error.alias("error"))
    good = settled.filter(F.col("error").isNull()).select("schema_name", "new_name")
    renamed = schemas.join(good, "schema_name", "left").withColumn(
        "schema_name", F.when(_is_live(), F.coalesce("new_name", "schema_name")).otherwise(F.col("schema_name"))
    ).select(*schemas.columns)
    return renamed, settled.filter(F.col("error").isNotNull())


def add_field(fields: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, errors). One new field per schema, refused at fifty live fields."""
    counts = live(fields).groupBy("schema_id").agg(F.count("*").alias("_n"))
    judged = incoming.join(counts, "schema_id", "left")
    full = F.coalesce("_n", F.lit(0)) >= MAX_FIELDS
    errors = judged.filter(full).select("schema_id", "name", F.lit(f"the schema already has {MAX_FIELDS} fields").alias("error"))
    return augment_fields(fields, judged.filter(~full).drop("_n")), errors


def _last_per_key(table: DataFrame, keys: list[str]) -> DataFrame:
    """The row with the greatest created_at per key."""
    return first_per_key(table, keys, [-F.unix_micros("created_at")])


def upsert_profiles(profiles: DataFrame, incoming: DataFrame, ready: DataFrame | None = None) -> DataFrame:
    """Last write wins on the signature pair; `ready` (dataset_id) admits only cleared datasets."""
    batch = incoming if ready is None else incoming.join(ready, "dataset_id", "left_semi")
    both = profiles.unionByName(batch.select(*profiles.columns))
    return _last_per_key(both, ["field_set_signature", "column_signature"])


def profiles_from(mappings: DataFrame, columns: DataFrame, signed: DataFrame, created_at: Column, vendor: Column | None = None) -> DataFrame:
    """The profiles a set of confirmed mappings leaves: (normalised, occurrence) pairs per dataset.

    signed: dataset_id, field_set_signature, column_signature.
    """
    return stored_mapping(mappings, columns).join(signed, "dataset_id").select(
        "dataset_id", "field_set_signature", "column_signature",
        F.sha2(F.concat("field_set_signature", "column_signature"), 256).alias("profile_id"), "field_mappings",
        F.lit(None).cast(HINT).alias("structural_hint"),
        (vendor if vendor is not None else F.lit(None)).cast("string").alias("vendor"), created_at.alias("created_at"),
    )


def record_aliases(aliases: DataFrame, fields: DataFrame, confirmed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every mapped column of a ready dataset as an alias. Needs a schema and a vendor.

    confirmed: schema_id, vendor, actor, created_at, seq, target_field, source_column.
    """
    usable = confirmed.filter(
        F.col("source_column").isNotNull() & F.col("schema_id").isNotNull() & (F.coalesce(strip(F.col("vendor")), F.lit("")) != "")
    )
    incoming = usable.join(live(fields).select("field_id", "schema_id", F.col("name").alias("target_field")), ["schema_id", "target_field"]).select(
        "field_id", "vendor", "source_column", F.lit("confirmed").alias("provenance_kind"), F.col("actor").alias("provenance_actor"),
        "created_at", F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("note"), "seq",
    )
    return add_aliases(aliases, incoming)


def list_vendors(aliases: DataFrame, fields: DataFrame) -> DataFrame:
    """Distinct non-blank vendors of live aliases."""
    return live_aliases(aliases, fields).select(strip(F.col("vendor")).alias("vendor")).filter(F.col("vendor") != "").distinct()


def upsert_templates(templates: DataFrame, incoming: DataFrame) -> DataFrame:
    """Field-set templates by name, last write wins. Columns: name, fields, created_at."""
    return _last_per_key(templates.unionByName(incoming.select(*templates.columns)), ["name"])


MASTER_ALIAS = (
    "struct<vendor:string,source_column:string,provenance_kind:string,provenance_actor:string,created_at:string,confidence:double,note:string>"
)
MASTER_FIELD = (
    "struct<name:string,description:string,type:string,allowed_values:array<string>,unit:string,required:boolean,"
    f"min:double,max:double,date_format:string,aliases:array<{MASTER_ALIAS}>>"
)
MASTER_MAP = f"struct<schema_version:int,id:string,name:string,created_by:string,created_at:string,first:int,fields:array<{MASTER_FIELD}>>"


ISO_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
PART_ENTRIES = 2_000  # fields and aliases one document tells; a larger dictionary is told by several


def export_master_map(schemas: DataFrame, fields: DataFrame, aliases: DataFrame, part_entries: int = PART_ENTRIES) -> DataFrame:
    """schema_name, envelope: live schemas as JSON documents, fields and aliases in order.

    A schema of up to `part_entries` fields and aliases is one document. A larger one is several of about that size, and all but its first name the
    position of their `first` field. Positions are counted in blocks, like line numbers. What stays together is one field with its aliases.
    """
    alias = F.struct("seq", F.struct(
        "vendor", "source_column", "provenance_kind", "provenance_actor",
        F.date_format("created_at", ISO_TIME).alias("created_at"), "confidence", "note",
    ).alias("a"))
    grouped = live_aliases(aliases, fields).groupBy("field_id").agg(F.array_sort(F.collect_list(alias)).alias("_a"))
    none = F.array().cast(f"array<{MASTER_ALIAS}>")
    entry = F.struct(
        "name", "description", "type", "allowed_values", "unit", "required", "min", "max", "date_format",
        F.coalesce(F.transform("_a", lambda x: x["a"]), none).alias("aliases"),
    )
    block = F.coalesce(F.floor(F.col("seq") / BLOCK_ROWS), F.lit(-(1 << 62)))  # fields without a number come first
    size = 1 + F.coalesce(F.size("_a"), F.lit(0))
    entries = settle(live(fields).join(grouped, "field_id", "left").select("schema_id", "field_id", "seq", block.alias("_block"), size.cast("bigint").alias("_size"), entry.alias("f")))
    sums = entries.groupBy("schema_id", "_block").agg(F.count("*").alias("_n"), F.sum("_size").alias("_sum"))
    blocks = Window.partitionBy("schema_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("schema_id", "_block").orderBy("seq", "field_id", "f.name").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    head = ["schema_name", "created_by", F.date_format("created_at", ISO_TIME).alias("created_at")]
    named = live(schemas).select("schema_id", *head)
    starts = settle(sums.select("schema_id", "_block", before("_n", blocks).alias("_fields"), before("_sum", blocks).alias("_entries"))).join(named, "schema_id")
    placed = entries.withColumn("_at", before(F.lit(1), inside)).withColumn("_told", before("_size", inside)).join(starts, ["schema_id", "_block"])
    placed = placed.withColumn("pos", (F.col("_fields") + F.col("_at")).cast("int")).withColumn("part", F.floor((F.col("_entries") + F.col("_told")) / part_entries))
    nested = placed.groupBy("schema_id", "schema_name", "created_by", "created_at", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "f"))).alias("_f"))
    empty = named.join(sums.select("schema_id").distinct(), "schema_id", "left_anti")
    told = nested.unionByName(empty, allowMissingColumns=True)
    first = F.try_element_at("_f", F.lit(1))["pos"]
    envelope = F.struct(
        F.lit(1).alias("schema_version"), F.col("schema_id").alias("id"), F.col("schema_name").alias("name"), "created_by", "created_at",
        F.when(first > 0, first).alias("first"),
        F.coalesce(F.transform("_f", lambda x: x["f"]), F.array().cast(f"array<{MASTER_FIELD}>")).alias("fields"),
    )
    return told.select("schema_name", F.to_json(envelope, {"ignoreNullFields": "true"}).alias("envelope"))


def read_master_maps(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Envelopes (map_id, envelope) as (fields with nested aliases, errors). Documents of one map share its id; positions count from their `first`."""
    parsed = envelopes.select("map_id", F.from_json("envelope", MASTER_MAP).alias("m"), F.from_json("envelope", "struct<fields:string>").alias("raw"))
    list_given = F.coalesce(F.trim("raw.fields"), F.lit("")).startswith("[")
    nameless = F.exists(F.coalesce("m.fields", F.array().cast(f"array<{MASTER_FIELD}>")), lambda f: F.coalesce(f["name"], F.lit("")) == "")
    error = (
        F.when(F.coalesce("m.name", F.lit("")) == "", "the map has no schema name")
        .when(~list_given | F.col("m.fields").isNull(), "'fields' must be a list")
        .when(nameless, "every field needs a name")
    )
    judged = parsed.withColumn("error", error)
    fields = judged.filter(F.col("error").isNull()).select("map_id", F.col("m.name").alias("schema_name"), F.coalesce("m.first", F.lit(0)).alias("_first"), F.posexplode("m.fields").alias("_at", "f")).select(
        "map_id", "schema_name", (F.col("_first") + F.col("_at")).alias("pos"), "f.*"
    )
    return fields, judged.filter(F.col("error").isNotNull()).select("map_id", "error")


def master_map_aliases(map_fields: DataFrame) -> DataFrame:
    """The aliases inside parsed maps: map_id, schema_name, field_name, field_seq, vendor, source_column, seq."""
    return map_fields.select("map_id", "schema_name", F.col("name").alias("field_name"), F.col("pos").alias("field_seq"), F.posexplode("aliases").alias("seq", "a")).select(
        "map_id", "schema_name", "field_name", "field_seq", "seq", "a.vendor", "a.source_column", "a.provenance_actor",
        F.col("a.created_at").try_cast("timestamp").alias("created_at"),  # fraction and offset where they are given
    )


def import_master_map(fields: DataFrame, aliases: DataFrame, target_schema_id: str, envelopes: DataFrame, imported_at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fields, aliases, errors). Adds what is missing (G3, then G4); stored provenance is kept."""
    map_fields, errors = read_master_maps(envelopes)
    map_fields = settle(map_fields)  # read for the fields, their ids and the aliases
    target = F.lit(target_schema_id)
    incoming = map_fields.select(
        field_id(target, F.col("name"), imported_at).alias("field_id"), target.alias("schema_id"), (F.col("pos") + 1_000_000).cast("bigint").alias("seq"),
        "name", "description", "type", "allowed_values", "unit", F.coalesce("required", F.lit(True)).alias("required"), "min", "max", "date_format",
    )
    next_fields = augment_fields(fields, incoming)
    ids = live(next_fields).filter(F.col("schema_id") == target).select("field_id", F.col("name").alias("field_name"))
    named = master_map_aliases(map_fields).join(ids, "field_name").select(
        "field_id", "vendor", "source_column", F.lit("from_map_file").alias("provenance_kind"), "provenance_actor",
        F.coalesce("created_at", imported_at).alias("created_at"), F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("string").alias("note"), F.col("seq").cast("bigint").alias("seq"),
    )
    next_aliases, _ = add_aliases(aliases, named)
    return next_fields, next_aliases, errors


def seed_presets(templates: DataFrame, presets: DataFrame) -> DataFrame:
    """Presets whose name is not there yet."""
    first = first_per_key(presets.select(*templates.columns), ["name"], ["created_at"])
    return templates.unionByName(first.join(templates.select("name"), "name", "left_anti"))


def profile_json(profiles: DataFrame) -> DataFrame:
    """The nested parts of a profile as JSON text."""
    return profiles.select(
        "profile_id", F.to_json("field_mappings").alias("field_mappings"), F.to_json("structural_hint").alias("structural_hint")
    )


def from_profile_json(stored: DataFrame) -> DataFrame:
    """G18 back: parts an older writer did not know load as null."""
    return stored.select(
        "profile_id",
        F.from_json("field_mappings", "array<struct<target_field:string,source_column_normalised:string,source_column_occurrence:int,inferred_value:string>>").alias("field_mappings"),
        F.from_json("structural_hint", HINT).alias("structural_hint"),
    )
