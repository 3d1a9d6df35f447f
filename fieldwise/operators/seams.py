"""Guarded seams to callables that a caller brings: proposer, ranker, judge, drafter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..model import MAPPING_SCHEMA
from ..session import settle


def guarded(call: Callable[[DataFrame], DataFrame], asked: DataFrame, schema: str, who: str) -> tuple[DataFrame, DataFrame]:
    """(answers, errors): what the callable answers in a job of its own, in `schema`; columns it leaves out are null.

    A callable that fails, when it plans or when its tasks run, or answers in columns that cannot be read, gives no answer and one error row
    (who, error): a broken helper costs its proposals, never the plan that asked.
    """
    spark = asked.sparkSession
    empty = spark.createDataFrame([], schema)
    try:
        given = call(asked)
        wanted = [f for f in empty.schema.fields if f.name in given.columns]
        answers = settle(empty.unionByName(given.select(*(given[f.name].cast(f.dataType).alias(f.name) for f in wanted)), allowMissingColumns=True))
    except Exception as e:  # whatever a caller's code raises
        message = str(e).strip().split("\n")[0][:300]
        return empty, spark.createDataFrame([(who, f"{who} failed: {type(e).__name__}: {message}")], "who string, error string")
    return answers, spark.createDataFrame([], "who string, error string")


# What each kind of callable answers in.
PROPOSALS = f"{MAPPING_SCHEMA}, position int"
RANKINGS = "dataset_id string, position int, schema_name string, reason string"
DRAFTS = "dataset_id string, position int, column_index int, name string, type string, required boolean, reason string"


def answered(call: Callable[[DataFrame], DataFrame], asked: DataFrame, schema: str, who: str, failures: list[DataFrame] | None) -> DataFrame:
    """`guarded` answers; the error frame goes to `failures` where a caller keeps one."""
    answers, errors = guarded(call, asked, schema, who)
    if failures is not None:
        failures.append(errors)
    return answers
