"""Scalar helpers against plain Python."""

from __future__ import annotations

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from fieldwise.functions import dates, numbers, text


def column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *[e(F.col("v")).alias(f"c{k}") for k, e in enumerate(exprs)]).orderBy("i").collect()]


def test_strip_matches_python(spark):
    values = ["a ", " \xa0x ", "\tq\n", "", " ", "　", "é"]
    assert [r[0] for r in column(spark, values, text.strip)] == [v.strip() for v in values]


def test_header_clean_and_normalise(spark):
    values = [" ID ", None, "Unnamed: 3", "Straße", "École", "A  B"]
    cleaned = [r[0] for r in column(spark, values, text.clean_header)]
    assert cleaned == ["ID", "", "", "Straße", "École", "A  B"]
    folded = [r[0] for r in column(spark, values, text.normalise_header)]
    assert folded == ["id", None, "unnamed: 3", "strasse", "école", "a b"]


def test_loose_normalise(spark):
    assert [r[0] for r in column(spark, [" Conc. (uM) ", "n_rep"], text.normalise_loose)] == ["conc um", "nrep"]


def test_to_float_follows_python_with_guards(spark):
    values = ["1", " 1.5 ", "-.5", "5.", "1e3", "nan", "-inf", "Infinity", "1d", "0x1p3", "1_000", "", "x", "1.0f"]
    got = [r[0] for r in column(spark, values, numbers.to_float)]
    expected = [1.0, 1.5, -0.5, 5.0, 1000.0, math.nan, -math.inf, math.inf, None, None, None, None, None, None]
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert (g is None and e is None) or g == e or (math.isnan(g) and math.isnan(e))


def test_decimal_comma(spark):
    values = ["1.234,56", "3,5", "12", "1,2,3", "", "3.698,10"]
    assert [r[0] for r in column(spark, values, numbers.decimal_comma)] == [1234.56, 3.5, 12.0, None, None, 3698.10]


def test_narrow_to_long(spark):
    values = ["3", "2.5", "nan", "inf", "-7.0", "1e300"]
    got = [r[0] for r in column(spark, values, lambda c: numbers.narrow_to_long(numbers.to_float(c)))]
    assert got == [3, None, None, None, -7, None]


def test_date_shapes(spark):
    values = ["2025-1-5", "2025/01/05 10:30", "20250101", "99990101", "03/11/2025", "3.11.25", "3-11/2025", "5", "45000", "abc", "03/11/2025 9:15:30"]
    assert [r[0] for r in column(spark, values, dates.date_shape)] == [
        "iso", "iso", "compact", "int", "dm", "dm", None, "int", "int", None, "dm",
    ]


def test_parse_date_against_strptime(spark):
    rng = random.Random(7)
    formats = ["%d/%m/%Y", "%m-%d-%y", "%Y-%m-%d", "%Y%m%d", "%d.%m.%Y %H:%M", "%d-%b-%Y", "%Y-%m-%dT%H:%M:%S"]
    cases = []
    for fmt in formats:
        for _ in range(40):
            day = dt.datetime(1969 + rng.randrange(99), 1, 1) + dt.timedelta(days=rng.randrange(366), minutes=rng.randrange(1440))
            cases.append((day.strftime(fmt), fmt))
            cases.append((day.strftime(rng.choice(formats)), fmt))
    cases += [("1/2/25", "%d/%m/%y"), ("31/02/2025", "%d/%m/%Y"), ("003/1/2025", "%d/%m/%Y"), ("12345-1-1", "%Y-%m-%d"), ("1/1/70", "%d/%m/%y"), ("1/1/68", "%d/%m/%y")]
    df = spark.createDataFrame([(i, v, f) for i, (v, f) in enumerate(cases)], "i int, v string, f string")
    got = [r.d for r in df.select("i", dates.parse_date(F.col("v"), F.col("f")).alias("d")).orderBy("i").collect()]
    for (value, fmt), result in zip(cases, got):
        try:
            expected = dt.datetime.strptime(value, fmt).date()
        except ValueError:
            expected = None
        assert result == expected, (value, fmt, result, expected)


def test_serial_bounds(spark):
    got = [r[0] for r in column(spark, ["25569", "73050", "25568", "73051", "46092", "x"], dates.serial_to_date)]
    assert got == [dt.date(1970, 1, 1), dt.date(2099, 12, 31), None, None, dt.date(2026, 3, 11), None]


def test_implied_order(spark):
    got = [r[0] for r in column(spark, ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%y", "%H:%M", "%d"], dates.implied_order)]
    assert got == ["iso", "day_first", "month_first", None, None]


def test_osa_distance(spark):
    pairs = [("tset", "test", 1), ("ca", "abc", 3), ("", "ab", 2), ("same", "same", 0), ("reuslt", "results", 2)]
    df = spark.createDataFrame([(a, b, d) for a, b, d in pairs], "a string, b string, d int")
    assert all(r.d == r.g for r in df.select("d", text.osa_distance("a", "b").alias("g")).collect())
