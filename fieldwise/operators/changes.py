"""Changesets: what a step does to the dictionary's tables, as one frame that is applied as one merge."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import union_all

OPS = ("insert", "update", "tombstone", "keep")


class Dictionary(NamedTuple):
    """The governed tables that change together."""

    schemas: DataFrame
    fields: DataFrame
    aliases: DataFrame


# What a row of each table is known by. An alias removed and written again is two rows.
KEYS = {"schemas": ("schema_id",), "fields": ("field_id",), "aliases": ("field_id", "vendor", "source_column", "created_at", "seq")}


def _identity(name: str) -> Column:
    return F.sha2(F.to_json(F.struct(*KEYS[name])), 256)


def _same(a: Column, b: Column) -> Column:
    return F.to_json(a) == F.to_json(b)


def changeset(before: Dictionary, after: Dictionary) -> DataFrame:
    """(table_name, op, id, schema_row, field_row, alias_row): every row of both versions once.

    `insert` is new, `tombstone` was live and is removed, `update` differs otherwise, `keep` is as it was; the row is the later version's, in the
    column of its table. Rows that a later version lacks are kept: nothing is ever deleted. Keys repeat as rows do; equal rows are one.
    """
    columns = dict(zip(Dictionary._fields, ("schema_row", "field_row", "alias_row"), strict=True))
    kinds = {c: getattr(before, name).schema.simpleString() for name, c in columns.items()}
    parts = []
    for name, column in columns.items():
        old, new = (getattr(v, name).select(_identity(name).alias("id"), F.struct(*getattr(before, name).columns).alias("row")).dropDuplicates(["id"]) for v in (before, after))
        both = old.withColumnRenamed("row", "was").join(new, "id", "full")
        op = (
            F.when(F.col("was").isNull(), "insert")
            .when(F.col("row").isNull() | _same(F.col("was"), F.col("row")), "keep")
            .when(F.col("was.removed_at").isNull() & F.col("row.removed_at").isNotNull(), "tombstone")
            .otherwise("update")
        )
        row = F.coalesce("row", "was")
        parts.append(both.select(F.lit(name).alias("table_name"), op.alias("op"), "id", *((row if c == column else F.lit(None)).cast(kinds[c]).alias(c) for c in columns.values())))
    return union_all(parts)


def apply_changes(current: Dictionary, changes: DataFrame) -> Dictionary:
    """The tables with a changeset merged in: changed rows replace theirs, new rows come, all others stay, also such as the changeset does not know.

    Applying a changeset again changes nothing.
    """
    out = {}
    for name, column in zip(Dictionary._fields, ("schema_row", "field_row", "alias_row"), strict=True):
        table = getattr(current, name)
        made = changes.filter((F.col("table_name") == name) & (F.col("op") != "keep")).select("id", column)
        known = table.select(_identity(name).alias("id"), "*")
        out[name] = known.join(made.select("id"), "id", "left_anti").drop("id").unionByName(made.select(f"{column}.*").select(table.columns))
    return Dictionary(**out)
