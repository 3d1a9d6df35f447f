"""Text helpers as Column expressions, plus the two Arrow helpers Spark has no built-in for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Strip Unicode white space from both ends; Spark's own trim stops at U+0020."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def clean_header(c: Column) -> Column:
    """Trimmed header; a missing or reader-made `Unnamed: n` label counts as blank."""
    return F.when(c.isNull() | c.startswith("Unnamed:"), F.lit("")).otherwise(strip(c))


@F.pandas_udf(T.StringType())
def _fold_unicode(values: pd.Series) -> pd.Series:
    return values.map(
        lambda s: None if s is None else " ".join(unicodedata.normalize("NFC", s).casefold().split())
    )


def normalise_header_native(c: Column) -> Column:
    """The ASCII case of `normalise_header`, entirely JVM-side."""
    blanks = F.lit(WHITESPACE)
    return F.btrim(F.regexp_replace(F.lower(c), r"[\s\x1c-\x1f]+", " "), blanks)


def normalise_header(c: Column) -> Column:
    """M1: NFC, casefold, single spaces.

    Use on header inventories, never on cell volume: it sends the column through Arrow.
    """
    return _fold_unicode(c)


def normalise_loose(c: Column) -> Column:
    """Lower case, letters, digits and white space only."""
    return F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}\s]", "")


def optimal_alignment(a: str, b: str) -> int:
    """Edit distance with adjacent transposition at cost one, for one already pruned pair."""
    rows, cols = len(a) + 1, len(b) + 1
    grid = [[i + j if i * j == 0 else 0 for j in range(cols)] for i in range(rows)]
    for i in range(1, rows):
        for j in range(1, cols):
            options = [
                grid[i - 1][j] + 1,
                grid[i][j - 1] + 1,
                grid[i - 1][j - 1] + (a[i - 1] != b[j - 1]),
            ]
            swapped = i > 1 and j > 1 and a[i - 2 : i] == b[j - 1] + b[j - 2]
            if swapped:
                options.append(grid[i - 2][j - 2] + 1)
            grid[i][j] = min(options)
    return grid[-1][-1]


@F.pandas_udf(T.IntegerType())
def osa_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """M18 on pruned pairs."""
    return pd.Series(
        [None if a is None or b is None else optimal_alignment(a, b) for a, b in zip(left, right)],
        dtype="Int32",
    )


def slug(c: Column) -> Column:
    """Lower case, every run of other characters a hyphen, no hyphen at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
