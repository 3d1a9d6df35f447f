"""Near-match suggestions for unmatched headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_loose, osa_distance
from ..model import NEAR_MAX_EDITS, NEAR_MAX_RATIO
from ..session import settle
from .common import first_per_key


def allowed_edits(length: Column) -> Column:
    """How many edits a known name of this length forgives."""
    return F.least(F.lit(NEAR_MAX_EDITS), F.floor(length * NEAR_MAX_RATIO)).cast("int")


def _segment(i: Column, length: Column, pieces: Column) -> tuple[Column, Column]:
    """Where the i-th of `pieces` segments of a name of this length starts, and how long it is."""
    start = F.floor(i * length / pieces).cast("int")
    return start, F.floor((i + 1) * length / pieces).cast("int") - start


def known_segments(known: Column) -> Column:
    """A known name cut into one segment more than its edits can spoil: array of (length, i, segment)."""
    n = F.length(known)
    pieces = 2 * allowed_edits(n) + 1

    def cut(i: Column) -> Column:
        start, size = _segment(i, n, pieces)
        return F.struct(n.alias("length"), i.alias("i"), F.substr(known, start + 1, size).alias("segment"))

    return F.transform(F.sequence(F.lit(0), pieces - 1), cut)


def needle_segments(needle: Column) -> Column:
    """What each segment of a known name could be in the needle: for all lengths in reach, at all shifts its edits allow."""
    m = F.length(needle)

    def at_length(length: Column) -> Column:
        allowed = allowed_edits(length)

        def of_piece(i: Column) -> Column:
            start, size = _segment(i, length, 2 * allowed + 1)

            def shifted(d: Column) -> Column:
                inside = (start + d >= 0) & (start + d + size <= m)
                return F.when(inside, F.struct(length.alias("length"), i.alias("i"), F.substr(needle, start + d + 1, size).alias("segment")))

            return F.transform(F.sequence(-allowed, allowed), shifted)

        return F.flatten(F.transform(F.sequence(F.lit(0), 2 * allowed), of_piece))

    lengths = F.sequence(m - NEAR_MAX_EDITS, m + NEAR_MAX_EDITS)
    near = F.filter(lengths, lambda n: (n > 0) & (allowed_edits(n) >= F.greatest(F.lit(1), F.abs(n - m))))
    return F.array_distinct(F.filter(F.flatten(F.transform(near, at_length)), lambda x: x.isNotNull()))


def near_pairs(needles: DataFrame, known: DataFrame) -> DataFrame:
    """(needle, known, edits) within the edit bounds, over distinct strings.

    An edit spoils one segment of the known name, a swap of neighbours at most two; of 2 x allowed + 1 segments one therefore stands in the needle
    as it was, moved by no more places than there are edits. Pairs come from an equi-join on (length, segment number, segment), and the exact distance
    is verified once per pair. A name of n characters has 3 or 5 keys, a needle at most 105, and all of them together are a small multiple of its length.
    """
    right = known.select("known").distinct().filter(allowed_edits(F.length("known")) >= 1).select("known", F.explode(known_segments(F.col("known"))).alias("x")).select("known", "x.*")
    left = needles.select("needle").distinct().select("needle", F.explode(needle_segments(F.col("needle"))).alias("x")).select("needle", "x.*")
    allowed = allowed_edits(F.length("known"))
    pairs = left.join(right, ["length", "i", "segment"]).select("needle", "known").distinct().filter(F.levenshtein("needle", "known") <= 2 * allowed)
    return pairs.withColumn("edits", osa_distance("needle", "known")).filter(F.col("edits") <= allowed)


def near_matches(columns: DataFrame, index: DataFrame, covered: DataFrame) -> DataFrame:
    """dataset_id, schema_name, header, field_name, resembles, edits. Suggestions, never applied.

    columns: dataset_id, col_idx, header; index: schema_name, norm, field_name; covered: the M11 output.
    Skips blank and already claimed headers, exact hits, fields already covered, and ties between fields.
    """
    loose = index.select("schema_name", normalise_loose(F.col("norm")).alias("known"), "field_name").filter(F.col("known") != "")
    keys = loose.groupBy("schema_name", "known").agg(
        F.min("field_name").alias("_a"), F.max("field_name").alias("_b"), F.count_if(F.col("field_name").isNull()).alias("_clash")
    ).select(
        "schema_name", "known",
        F.when((F.col("_a") == F.col("_b")) & (F.col("_clash") == 0), F.col("_a")).alias("field_name"),
    )
    headers = columns.select("dataset_id", "header").distinct().withColumn("needle", normalise_loose(F.col("header"))).filter(F.col("needle") != "")
    close = near_pairs(headers, keys.filter(F.col("field_name").isNotNull())).join(
        keys.filter(F.col("field_name").isNotNull()), "known"
    )
    exact = keys.select("schema_name", F.col("known").alias("needle"))
    open_pairs = settle(close.join(exact, ["schema_name", "needle"], "left_anti"))  # four readers below
    best = open_pairs.groupBy("schema_name", "needle").agg(F.min("edits").alias("edits"))
    at_best = open_pairs.join(best, ["schema_name", "needle", "edits"])
    single = at_best.groupBy("schema_name", "needle").agg(F.min("field_name").alias("_a"), F.max("field_name").alias("_b")).filter("_a = _b").select("schema_name", "needle")
    chosen = first_per_key(
        at_best.join(single, ["schema_name", "needle"], "left_semi"), ["schema_name", "needle"], ["edits", "field_name", "known"]
    )
    suggested = headers.join(chosen, "needle").select(
        "dataset_id", "schema_name", "header", "field_name", F.col("known").alias("resembles"), "edits"
    )
    return suggested.join(covered.select("dataset_id", "schema_name", "header").distinct(), ["dataset_id", "schema_name", "header"], "left_anti").join(
        covered.select("dataset_id", "schema_name", "field_name").distinct(), ["dataset_id", "schema_name", "field_name"], "left_anti"
    )
