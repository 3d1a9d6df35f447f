"""Small relational helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the least by `order` and then by every other column.

    A mergeable minimum instead of a ranked window: a hot key is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    ranks = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)]
    best = F.min(F.struct(*ranks, F.struct(*rest).alias("_row"))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best._row.*").select(*df.columns)


def descending(c: Column) -> Column:
    """An ascending sort key that orders a numeric column downwards."""
    return -c


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Exchanged by `keys` into partitions whose number stands, for header lists that are sorted next.

    AQE merges partitions by their compressed size. Headers repeat, so that what is small there is many times as large in a task's sorts.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


BLOCK_ROWS = 8192


def running_sum(df: DataFrame, keys: Sequence[str], position: str, value: Column, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sum of `value` over the rows before each row of its key.

    Blocked like `number_lines`: whole blocks are summed first, so a file holding a third of
    the corpus is spread over many tasks.
    """
    marked = df.withColumn("_value", value.cast("bigint")).withColumn("_block", F.floor(F.col(position) / block_rows))
    sums = marked.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    before_block = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before_block), F.lit(0)).alias("_start"))
    before_row = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return (
        marked.withColumn("_inside", F.coalesce(F.sum("_value").over(before_row), F.lit(0)))
        .join(starts, [*keys, "_block"])
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop("_value", "_block", "_start", "_inside")
    )


def running_parity(df: DataFrame, keys: Sequence[str], position: str, odd: Column, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Whether an odd number of `odd` rows precede each row of its key."""
    return running_sum(df, keys, position, odd.cast("int"), name, block_rows).withColumn(name, F.col(name) % 2 == 1)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
