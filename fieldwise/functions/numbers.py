"""Number shapes and conversions (P1 evidence, C1-C3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The four locales a column can have.
DECIMAL_COMMA = "decimal_comma"
DECIMAL_POINT = "decimal_point"
AMBIGUOUS = "ambiguous"
NON_NUMERIC = "non_numeric"

# Number shapes.
COMMA_DECIMAL = r"^-?[0-9][0-9.]*,[0-9]+$"
COMMA_DECIMAL_THREE = r"^-?[0-9][0-9.]*,[0-9]{3}$"
DOT_DECIMAL = r"^-?[0-9]+\.[0-9]+$"
PLAIN_INTEGER = r"^-?[0-9]+$"
FLOAT_TEXT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
FLOAT_WORD = r"^(?i)[+-]?(nan|inf|infinity)$"


def to_float(c: Column) -> Column:
    """Text to double; null where the text is no number. Accepts nan and infinity words."""
    text = strip(c)
    word = F.lower(text)
    special = (
        F.when(word.endswith("nan"), F.lit(float("nan")))
        .when(word.startswith("-"), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf")))
    )
    return F.when(text.rlike(FLOAT_TEXT), text.try_cast("double")).when(text.rlike(FLOAT_WORD), special)


def decimal_comma(c: Column) -> Column:
    """Dots are grouping, the comma is the decimal point; null on failure."""
    return to_float(F.replace(F.replace(strip(c), F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def parse_number(c: Column, locale: Column) -> Column:
    """A double wherever the locale settles how to read it, else null."""
    return F.when(locale == DECIMAL_COMMA, decimal_comma(c)).when(locale == DECIMAL_POINT, to_float(c))


def number_flag(c: Column, locale: Column, parsed: Column) -> Column:
    """Text columns and failed parses flag; an unsettled locale passes the raw text through."""
    settled = F.coalesce(locale.isin(DECIMAL_COMMA, DECIMAL_POINT), F.lit(False))
    return c.isNotNull() & (
        F.coalesce(locale == NON_NUMERIC, F.lit(False)) | (settled & parsed.isNull())
    )


def narrow_to_long(x: Column) -> Column:
    """Integral doubles as bigint; fractional, NaN and infinite values give null."""
    usable = ~F.isnan(x) & (F.abs(x) < F.lit(9.2e18)) & (x == F.floor(F.when(F.abs(x) < F.lit(9.2e18), x)))
    return F.when(usable, x.try_cast("bigint"))


def locale_aggregates(value: Column) -> dict[str, Column]:
    """Mergeable evidence for P1: four bits per column, kept as fixed-width buffers."""
    text = strip(value)
    comma = text.rlike(COMMA_DECIMAL)
    return {
        "any_comma": F.bool_or(comma),
        "any_comma_not_three": F.bool_or(comma & ~text.rlike(COMMA_DECIMAL_THREE)),
        "any_dot": F.bool_or(text.rlike(DOT_DECIMAL)),
        "any_integer": F.bool_or(text.rlike(PLAIN_INTEGER)),
    }


def locale_verdict(comma: Column, comma_not_three: Column, dot: Column, integer: Column) -> Column:
    """P1 decision over the four evidence bits (null bits count as false)."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~yes(comma) & ~yes(dot) & ~yes(integer), NON_NUMERIC)
        .when(yes(comma) & yes(dot), AMBIGUOUS)
        .when(yes(comma) & ~yes(comma_not_three), AMBIGUOUS)
        .when(yes(comma), DECIMAL_COMMA)
        .otherwise(DECIMAL_POINT)
    )
