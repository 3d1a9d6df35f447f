"""Master maps told in documents of bounded size, and read back whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldwise.operators import dictionary


def tables(spark, n_fields, n_aliases):
    at = F.lit("2024-01-01").cast("timestamp")
    gone = [F.lit(None).cast("timestamp").alias("removed_at"), F.lit(None).cast("string").alias("removed_by")]
    none = F.lit(None).cast("string")
    schemas = spark.createDataFrame([("s", 0), ("bare", 1)], "schema_id string, seq bigint").select("schema_id", F.col("schema_id").alias("schema_name"), F.lit("me").alias("created_by"), at.alias("created_at"), "seq", *gone)
    ids = spark.range(n_fields)
    fields = ids.select(
        F.concat(F.lit("f"), "id").alias("field_id"), F.lit("s").alias("schema_id"), (F.col("id") * 5000).alias("seq"), F.concat(F.lit("n"), "id").alias("name"), none.alias("description"), F.lit("text").alias("type"),
        F.lit(None).cast("array<string>").alias("allowed_values"), none.alias("unit"), F.lit(True).alias("required"), F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"), none.alias("date_format"), *gone,
    )
    aliases = ids.crossJoin(spark.range(n_aliases).withColumnRenamed("id", "k")).select(
        F.concat(F.lit("f"), "id").alias("field_id"), F.concat(F.lit("v"), "k").alias("vendor"), F.lit("c").alias("source_column"), F.lit("manual").alias("provenance_kind"), F.lit("me").alias("provenance_actor"), at.alias("created_at"),
        F.lit(None).cast("double").alias("confidence"), none.alias("note"), F.col("k").alias("seq"), *gone,
    )
    return schemas, fields, aliases


def test_a_large_schema_is_told_in_documents_of_bounded_size(spark):
    got = dictionary.export_master_map(*tables(spark, 40, 9), part_entries=100)
    maps = got.select(F.col("schema_name").alias("map_id"), "envelope").cache()
    sizes = sorted(r.n for r in maps.filter("map_id = 's'").select(F.size(F.from_json("envelope", dictionary.MASTER_MAP)["fields"]).alias("n")).collect())
    assert sizes == [10, 10, 10, 10]
    back, errors = dictionary.read_master_maps(maps)
    rows = sorted((r.pos, r.name, [a.vendor for a in r.aliases]) for r in back.collect())
    assert rows == [(i, f"n{i}", [f"v{k}" for k in range(9)]) for i in range(40)]
    assert errors.count() == 0
    assert maps.filter("map_id = 'bare'").count() == 1


def test_a_small_schema_stays_one_document(spark):
    rows = dictionary.export_master_map(*tables(spark, 5, 3)).collect()
    assert sorted(r.schema_name for r in rows) == ["bare", "s"]
    assert not any('"first"' in r.envelope for r in rows)
