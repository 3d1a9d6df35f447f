"""Queries over the given tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


READ: set[str] = set()  # the given tables read since the set was last cleared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, as stored; the session's split size sets how many tasks read it."""
    READ.add(f"{sf_dir}/{name}.parquet")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- text forms by integer arithmetic, since engines print doubles differently ----------------


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("bigint")


def comma_money(c: Column) -> Column:
    """1.234,56 for a non-negative amount below a million; a minus sign in front otherwise."""
    n = F.abs(cents(c))
    whole = F.floor(n / 100).cast("bigint")
    grouped = F.when(
        whole >= 1000, F.concat(F.floor(whole / 1000).cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"))
    ).otherwise(whole.cast("string"))
    return F.concat(F.when(cents(c) < 0, "-").otherwise(""), grouped, F.lit(","), F.lpad((n % 100).cast("string"), 2, "0"))


def dot_money(c: Column) -> Column:
    n = F.abs(cents(c))
    return F.concat(F.when(cents(c) < 0, "-").otherwise(""), F.floor(n / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def sql_cents(c: str) -> str:
    return f"cast(round({c}*100) as bigint)"


def sql_comma_money(c: str) -> str:
    n = f"abs({sql_cents(c)})"
    return (
        f"(case when {sql_cents(c)}<0 then '-' else '' end || case when {n}//100>=1000 then "
        f"cast({n}//100000 as varchar)||'.'||lpad(cast(({n}//100)%1000 as varchar),3,'0') else cast({n}//100 as varchar) end || ',' || lpad(cast({n}%100 as varchar),2,'0'))"
    )


def sql_dot_money(c: str) -> str:
    n = f"abs({sql_cents(c)})"
    return f"(case when {sql_cents(c)}<0 then '-' else '' end || cast({n}//100 as varchar)||'.'||lpad(cast({n}%100 as varchar),2,'0'))"


def pad2(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def day(c: Column) -> Column:
    return F.dayofmonth(c)


def sql_values(rows: list[tuple], names: list[str]) -> str:
    """The same inventory as a VALUES list."""

    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(names)})"
