"""What a confirmed run leaves for the next one: saved profiles and aliases."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FieldSet, Tables
from ..operators.dictionary import profiles_from, record_aliases, upsert_profiles
from ..session import settle
from .pipeline import signatures


class Learned(NamedTuple):
    profiles: DataFrame
    aliases: DataFrame


def learn(
    tables: Tables,
    confirmed: DataFrame,
    field_set: FieldSet,
    profiles: DataFrame,
    aliases: DataFrame,
    schema_fields: DataFrame,
    vendors: DataFrame,
    actor: Column,
    at: Column,
) -> Learned:
    """Saves each confirmed dataset's mapping as a profile and its columns as the vendor's aliases.

    confirmed: the mappings the gate let pass; vendors: dataset_id, vendor (null or blank leaves no alias);
    schema_fields: the dictionary's fields, whose schema_id is the field set's name. The next run over the same
    layout replays the profile and asks nothing.
    """
    fields = field_set.frame(tables.rows.sparkSession)
    datasets = tables.datasets.join(confirmed.select("dataset_id").distinct(), "dataset_id", "left_semi").withColumn("schema_name", F.lit(field_set.name))
    signed = signatures(tables.columns, fields, datasets).drop("schema_name")
    saved = profiles_from(confirmed, tables.columns, signed, at).drop("vendor").join(vendors.select("dataset_id", "vendor"), "dataset_id", "left")
    asked = confirmed.join(vendors.select("dataset_id", "vendor"), "dataset_id").select(
        F.lit(field_set.name).alias("schema_id"), "vendor", actor.alias("actor"), at.alias("created_at"), F.xxhash64("dataset_id", "target_field").alias("seq"), "target_field", "source_column"
    )
    next_aliases, _ = record_aliases(aliases, schema_fields, asked)
    return Learned(settle(upsert_profiles(profiles, saved)), settle(next_aliases))
