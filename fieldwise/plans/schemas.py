"""Which schema fits: scores, a ranker for what nothing scored, a drafter for what no schema fits."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from ..operators.closures import draft_schemas
from ..operators.common import union_all
from ..operators.matching import Proposer, alias_index, preselect, rank_unmatched, score_schemas
from ..session import settle


class SchemaChoice(NamedTuple):
    scored: DataFrame
    preselected: DataFrame  # dataset_id, tie, preselected
    suggestions: DataFrame  # dataset_id, schema_name, reason: the ranker's, for datasets that nothing scored
    drafts: DataFrame  # new fields, for datasets without either
    errors: DataFrame  # who, error


def choose_schemas(
    columns: DataFrame,
    fields: DataFrame,
    aliases: DataFrame | None = None,
    replayed: DataFrame | None = None,
    ranker: Proposer | None = None,
    drafter: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None,
    sample: DataFrame | None = None,
    defaults: DataFrame | None = None,
) -> SchemaChoice:
    """Every dataset by the first that knows it: coverage, then the ranker, then the drafter; each sees only what those before left open.

    The open sets come from the matching itself, by anti-joins. A ranker or drafter that fails costs its answers and leaves an error.
    """
    spark = columns.sparkSession
    scored = settle(score_schemas(columns, fields, alias_index(fields, aliases), replayed))
    failures: list[DataFrame] = []
    datasets = columns.select("dataset_id").distinct()
    suggestions = settle(rank_unmatched(datasets, scored, fields.select("schema_name"), ranker, failures))
    undecided = datasets.join(scored.select("dataset_id").distinct(), "dataset_id", "left_anti").join(suggestions.select("dataset_id"), "dataset_id", "left_anti")
    none = spark.createDataFrame([], "dataset_id string, position int, source_header string, name string, type string, required boolean, reason string")
    drafts = none if drafter is None else draft_schemas(undecided, columns, sample, drafter, failures)
    return SchemaChoice(scored, preselect(scored, defaults), suggestions, drafts, union_all([spark.createDataFrame([], "who string, error string"), *failures]))
