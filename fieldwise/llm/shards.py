"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, settled

BLOCKS = 256  # local permutations; also the pieces a shard is put in order by
SEED = 20_240_601


def communication_matrix(block_rows: list[int], n_shards: int, seed: int) -> np.ndarray:
    """How many rows each block gives to each shard, drawn as a uniform permutation would deal them.

    Shard sizes are exact: the total split as evenly as whole rows allow, larger shards first. Row b is
    multivariate hypergeometric in what the shards still lack.
    """
    total = sum(block_rows)
    lacking = np.array([total // n_shards + (s < total % n_shards) for s in range(n_shards)], dtype=np.int64)
    rng = np.random.default_rng(seed)
    matrix = np.zeros((len(block_rows), n_shards), dtype=np.int64)
    for b, rows in enumerate(block_rows):
        if rows:  # the marginals method has no limit on the population
            matrix[b] = rng.multivariate_hypergeometric(lacking, rows, method="marginals")
            lacking -= matrix[b]
    return matrix


def shuffle_into_shards(df: DataFrame, n_shards: int = 8, seed: int = SEED, blocks: int = BLOCKS) -> DataFrame:
    """All rows and columns of `df`, plus `shard` (0..n_shards-1) and `slot` (gapless from 0 in each shard).

    Shard sizes differ by one row at most (law `rows`). Rows are numbered once and written to the shared
    folder, so that counting and dealing see the same rows. They are dealt to `blocks` blocks whatever
    they hold: equal ids, texts or repeated rows spread like any others. Only blocks x shards counts
    reach the driver, whatever the input's size. Block b's rows, in random order, fill its counts in the matrix (local
    permutation); after the exchange each shard's rows are put in random order by random pieces of it.
    Nulls are ordinary values; an empty table gives an empty result. Columns named
    `shard` or `slot` are replaced.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    row, block, until_, at_, piece, start, in_, count = (fresh(df, c) for c in ("_row", "_block", "_until", "_at", "_piece", "_start", "_in", "_count"))
    numbered = df.withColumn(row, F.monotonically_increasing_id())
    base = settled(numbered.withColumn(block, F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(blocks)).cast("int")), "shard-rows")

    counted = {r[0]: r[1] for r in base.groupBy(block).count().collect()}  # one row a block
    matrix = communication_matrix([counted.get(b, 0) for b in range(blocks)], n_shards, seed)
    until = matrix.cumsum(axis=1)
    lines = [(b, [int(x) for x in until[b]]) for b in range(blocks)]
    dealt = spark.createDataFrame(lines, f"{block} int, {until_} array<bigint>")  # blocks x shards numbers

    at = Window.partitionBy(block).orderBy(F.xxhash64(row, F.lit(seed + 1)), row)
    placed = (
        base.withColumn(at_, F.row_number().over(at))
        .join(F.broadcast(dealt), block)
        .withColumn("shard", F.size(F.filter(until_, lambda u: u < F.col(at_))))
        .withColumn(piece, F.pmod(F.xxhash64(row, F.lit(seed + 2)), F.lit(blocks)).cast("int"))
        .drop(until_, at_, block)
    )
    counts = placed.groupBy("shard", piece).agg(F.count("*").alias(count))
    before = Window.partitionBy("shard").orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(start, F.coalesce(F.sum(count).over(before), F.lit(0))).drop(count)  # shards x blocks rows
    inside = Window.partitionBy("shard", piece).orderBy(F.xxhash64(row, F.lit(seed + 3)), row)
    return (
        placed.withColumn(in_, F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["shard", piece])
        .withColumn("slot", (F.col(start) + F.col(in_)).cast("bigint"))
        .select(*df.columns, "shard", "slot")
    )
