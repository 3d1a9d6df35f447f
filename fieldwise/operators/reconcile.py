"""Reconciling an incoming dictionary with the master."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import mapping_columns
from ..session import settle
from .common import first_per_key
from .matching import vendor_alias_index, with_norm

PAIR = ["vendor", "norm"]
DECISIONS = ("keep_master", "take_map_file")


def detect_conflicts(incoming: DataFrame, master: DataFrame) -> DataFrame:
    """Vendor, source_column, norm, master_field, map_file_field where the two disagree.

    Both sides carry schema_name, vendor, source_column, field_name, field_seq, seq. The master holds
    one field per (vendor, normalised column), so the equi-join yields at most one row per incoming alias.
    """
    index = vendor_alias_index(master).groupBy(*PAIR).agg(F.max("field_name").alias("master_field"))
    asked = with_norm(incoming, "source_column").select("vendor", "source_column", "norm", F.col("field_name").alias("map_file_field"))
    return asked.join(index, PAIR).filter(F.col("master_field") != F.col("map_file_field")).select(
        "vendor", "source_column", "norm", "master_field", "map_file_field"
    )


def undecided(conflicts: DataFrame, choices: DataFrame) -> DataFrame:
    """R2: conflicts without a valid decision; while any remain, nothing is written."""
    decided = with_norm(choices.filter(F.col("decision").isin(*DECISIONS)), "source_column").select(*PAIR).distinct()
    return conflicts.join(decided, PAIR, "left_anti")


def override_index(choices: DataFrame, master: DataFrame, incoming: DataFrame) -> DataFrame:
    """Vendor, norm, field_name as decided, for this run only."""
    asked = first_per_key(with_norm(choices, "source_column").select(*PAIR, "decision"), PAIR, ["decision"])
    ours = vendor_alias_index(master).groupBy(*PAIR).agg(F.max("field_name").alias("_master"))
    theirs = vendor_alias_index(incoming).groupBy(*PAIR).agg(F.max("field_name").alias("_map"))
    joined = asked.join(ours, PAIR, "left").join(theirs, PAIR, "left")
    field = F.when(F.col("decision") == "take_map_file", F.col("_map")).otherwise(F.col("_master"))
    return joined.select(*PAIR, field.alias("field_name")).filter(F.col("field_name").isNotNull())


def reconcile_map(columns: DataFrame, targets: DataFrame, index: DataFrame, overrides: DataFrame | None, vendors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mappings, uncovered) from one vendor's aliases, overrides first.

    index: the M8 output; vendors: dataset_id, vendor; targets as for M12.
    """
    base = index.select(*PAIR, "field_name")
    if overrides is not None:
        base = base.join(overrides.select(*PAIR), PAIR, "left_anti").unionByName(overrides.select(*PAIR, "field_name"))
    hits = with_norm(columns, "header").join(vendors, "dataset_id").join(base, PAIR)
    covered = settle(hits.groupBy("dataset_id", F.col("field_name").alias("target_field")).agg(
        F.min(F.struct("col_idx", "header", "vendor")).alias("_m")
    ).select("dataset_id", "target_field", "_m.header", "_m.vendor"))  # what is filled and what is not are both read off it
    key = ["dataset_id", "target_field"]
    mappings = targets.join(covered, key).select(*mapping_columns(
        source_column=F.col("header"), confidence=F.lit(1.0),
        reasoning=F.concat(F.lit("crosswalk alias of "), F.col("vendor"), F.lit(" for '"), F.col("header"), F.lit("'")),
    ))
    return mappings, targets.join(covered, key, "left_anti")
