"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwise.session import remove_folder, run_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, what: str) -> DataFrame:
    """Write a small intermediate table into the shared checkpoint folder and go on from the files.

    Lost executors then reread files, every later reader sees the same rows, and the table's true
    size decides whether a join may broadcast it.
    """
    folder = f"{run_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    _FOLDERS[out] = folder
    return out


_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Remove settled tables that nothing reads any more: what was made of them is settled itself."""
    for df in tables:
        remove_folder(df.sparkSession, _FOLDERS.pop(df))


def release(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files that only settled tables needed; it does so when it collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """Exchange by a hash of the row, for few but costly rows: the same rows in the same partitions on every run."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 3, F.xxhash64(*df.columns))


def fresh(df: DataFrame, name: str) -> str:
    """A column name the frame does not have, whatever extra columns it came with."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor: the fold a document is in. A null id is in no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow, a bounded piece of rows at a time: neither long texts nor large batches pile up in a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                out = fn(piece)
                if out is None:
                    continue
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut so that a piece holds about `limit` bytes, or one row."""
    if batch.num_rows == 0:
        return
    rows = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, given the words' 64-bit hashes; fewer words than n give one run of all."""
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total = mix(total * MIX_A + words[k : len(words) - n + 1 + k])
    return total
