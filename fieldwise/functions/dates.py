"""Date shapes, order evidence and format handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# Verdicts.
DAY_FIRST = "day_first"
MONTH_FIRST = "month_first"
ISO = "iso"
AMBIGUOUS = "ambiguous"
INVALID = "invalid"
NON_DATE = "non_date"
EXCEL_SERIAL = "excel_serial"

# Plausible serial days and compact years.
SERIAL_MIN = 25569
SERIAL_MAX = 73050
COMPACT_YEAR_MIN = 1900
COMPACT_YEAR_MAX = 2100

# Date shapes.
ISO_SHAPE = r"^[0-9]{4}([/\-.])[0-9]{1,2}\1[0-9]{1,2}(\s+[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$"
DM_SHAPE = r"^[0-9]{1,2}([/\-.])[0-9]{1,2}\1([0-9]{2}|[0-9]{4})(\s+[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$"
COMPACT_SHAPE = r"^[0-9]{8}$"
BARE_INTEGER = r"^[0-9]+$"

_SEPARATORS = ["-", "/", "."]
_TIMES = ["", " %H:%M", " %H:%M:%S"]


def date_shape(c: Column) -> Column:
    """The one shape a value has: iso, compact, dm, int, or null."""
    return shape_of(strip(c))


def shape_of(text: Column) -> Column:
    """P4 for already stripped text."""
    year = F.substring(text, 1, 4).try_cast("int")
    return F.when(
        text.rlike("^[0-9]"),
        F.when(text.rlike(ISO_SHAPE), "iso")
        .when(text.rlike(COMPACT_SHAPE) & year.between(COMPACT_YEAR_MIN, COMPACT_YEAR_MAX), "compact")
        .when(text.rlike(DM_SHAPE), "dm")
        .when(text.rlike(BARE_INTEGER), "int"),
    )


def _real_day(year: Column, month: Column, day: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    length = (
        F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    )
    return (year >= 1) & month.between(1, 12) & (day >= 1) & (day <= length)


def with_date_parts(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Adds, per named value, one struct of everything order evidence needs; null fields where shapeless.

    Staged projections: text, shape and number pieces are each computed once per value and only
    referred to afterwards. `code` packs separator, year width and time suffix into 0..17, so
    formats compare as integers.
    """
    kept = df.columns
    df = df.withColumns({f"{n}_text": strip(v) for n, v in values.items()})
    df = df.withColumns({f"{n}_shape": shape_of(F.col(f"{n}_text")) for n in values})
    df = df.withColumns({
        f"{n}_pieces": F.when(F.col(f"{n}_shape").isin("iso", "dm"), F.split(f"{n}_text", r"[^0-9]+")) for n in values
    })
    df = df.withColumns({
        f"{n}_n{i}": F.try_element_at(f"{n}_pieces", F.lit(i)).try_cast("int") for n in values for i in range(1, 7)
    })
    return df.select(*kept, *[_parts(n).alias(n) for n in values])


def _parts(name: str) -> Column:
    text, shape, pieces = (F.col(f"{name}_{k}") for k in ("text", "shape", "pieces"))
    one, two, three, hour, minute, second = (F.col(f"{name}_n{i}") for i in range(1, 7))
    iso, dm = shape == "iso", shape == "dm"
    sep_at = F.when(iso, 5).otherwise(F.length(F.try_element_at(pieces, F.lit(1))) + 1)
    sep_text = F.substring(text, sep_at, F.lit(1))
    sep = F.when(sep_text == "-", 0).when(sep_text == "/", 1).otherwise(2)
    time_code = F.when(hour.isNull(), 0).when(second.isNull(), 1).otherwise(2)
    clock = hour.isNull() | ((hour <= 23) & (minute <= 59) & (F.coalesce(second, F.lit(0)) <= 59))
    long_year = F.length(F.try_element_at(pieces, F.lit(3))) == 4
    full_year = F.when(long_year, three).when(three >= 69, three + 1900).otherwise(three + 2000)
    compact_ok = _real_day(
        F.substring(text, 1, 4).try_cast("int"), F.substring(text, 5, 2).try_cast("int"), F.substring(text, 7, 2).try_cast("int"),
    )
    short = F.length(text) <= 9
    return F.struct(
        shape.alias("shape"),
        (text != "").alias("filled"),
        F.when(iso | dm, sep * 6 + F.when(iso | long_year, 3).otherwise(0) + time_code).cast("int").alias("code"),
        F.when(dm, one > 12).alias("first_over"),
        F.when(dm, two > 12).alias("second_over"),
        F.when(iso, _real_day(one, two, three) & clock).when(shape == "compact", compact_ok).alias("iso_ok"),
        F.when(dm, _real_day(full_year, two, one) & clock).alias("day_first_ok"),
        F.when(dm, _real_day(full_year, one, two) & clock).alias("month_first_ok"),
        F.when(shape == "int", short & F.coalesce(F.when(short, text.try_cast("int")).between(SERIAL_MIN, SERIAL_MAX), F.lit(False))).alias("serial_ok"),
    )


def order_aggregates(parts: Column, row_idx: Column) -> dict[str, Column]:
    """Mergeable evidence for P5. Every buffer is fixed width, so Spark hashes instead of sorting."""
    shape = parts["shape"]
    code = parts["code"]
    iso_code = F.when(shape == "iso", code)
    dm_code = F.when(shape == "dm", code)
    packed = F.shiftleft(row_idx.cast("bigint"), 5) + F.when(shape == "dm", code).cast("bigint")
    return {
        "n_iso": F.count_if(shape == "iso"),
        "n_compact": F.count_if(shape == "compact"),
        "n_dm": F.count_if(shape == "dm"),
        "n_int": F.count_if(shape == "int"),
        "iso_code_min": F.min(iso_code),
        "iso_code_max": F.max(iso_code),
        "iso_ok": F.bool_and(parts["iso_ok"]),
        "dm_code_min": F.min(dm_code),
        "dm_code_max": F.max(dm_code),
        "dm_first": F.min(packed),
        "first_over": F.bool_or(parts["first_over"]),
        "second_over": F.bool_or(parts["second_over"]),
        "day_first_ok": F.bool_and(parts["day_first_ok"]),
        "month_first_ok": F.bool_and(parts["month_first_ok"]),
        "serial_ok": F.bool_and(parts["serial_ok"]),
    }


def _choice(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def format_from_code(code: Column, order: str) -> Column:
    """The strptime format a packed shape code stands for under an order."""
    sep = _choice(F.floor(code / 6), _SEPARATORS)
    year = F.when(F.floor(code / 3) % 2 == 1, "%Y").otherwise("%y")
    time = _choice(code % 3, _TIMES)
    if order == ISO:
        return F.concat(F.lit("%Y"), sep, F.lit("%m"), sep, F.lit("%d"), time)
    first, second = ("%d", "%m") if order == DAY_FIRST else ("%m", "%d")
    return F.concat(F.lit(first), sep, F.lit(second), sep, year, time)


def order_verdict(e: Column) -> Column:
    """P5: the verdict struct for one column's evidence struct."""
    dm_code = F.when(e["dm_first"].isNotNull(), (e["dm_first"] % 32).cast("int"))
    uniform_dm = e["dm_code_min"] == e["dm_code_max"]
    has_iso = (e["n_iso"] + e["n_compact"]) > 0
    iso_good = e["iso_ok"] & (
        (e["n_iso"] == 0) | ((e["n_compact"] == 0) & (e["iso_code_min"] == e["iso_code_max"]))
    )
    first, second = e["first_over"], e["second_over"]
    order = (
        F.when(has_iso, F.when(iso_good, ISO).otherwise(INVALID))
        .when(
            e["n_dm"] > 0,
            F.when(first & second, INVALID)
            .when(first, F.when(uniform_dm & e["day_first_ok"], DAY_FIRST).otherwise(INVALID))
            .when(second, F.when(uniform_dm & e["month_first_ok"], MONTH_FIRST).otherwise(INVALID))
            .otherwise(AMBIGUOUS),
        )
        .when(e["n_int"] > 0, F.when(e["serial_ok"], EXCEL_SERIAL).otherwise(NON_DATE))
        .otherwise(NON_DATE)
    )
    day_format = format_from_code(dm_code, DAY_FIRST)
    month_format = format_from_code(dm_code, MONTH_FIRST)
    date_format = (
        F.when(order == EXCEL_SERIAL, EXCEL_SERIAL)
        .when(
            order == ISO,
            F.when(e["n_iso"] > 0, format_from_code(e["iso_code_min"], ISO)).otherwise("%Y%m%d"),
        )
        .when(order == DAY_FIRST, day_format)
        .when(order == MONTH_FIRST, month_format)
    )
    return F.struct(
        order.alias("order"),
        date_format.alias("date_format"),
        F.when(order == AMBIGUOUS, day_format).alias("day_first_format"),
        F.when(order == AMBIGUOUS, month_format).alias("month_first_format"),
        F.coalesce(uniform_dm & e["day_first_ok"], F.lit(False)).alias("day_first_fits"),
        F.coalesce(uniform_dm & e["month_first_ok"], F.lit(False)).alias("month_first_fits"),
    )


def implied_order(fmt: Column) -> Column:
    """The component order a declared format implies."""
    day, month = F.instr(fmt, "%d"), F.instr(fmt, "%m")
    return F.when(
        (day > 0) | (month > 0),
        F.when(fmt.startswith("%Y"), ISO).when(
            (day > 0) & (month > 0), F.when(day < month, DAY_FIRST).otherwise(MONTH_FIRST)
        ),
    )


def format_for_order(day_first_format: Column, month_first_format: Column, answer: Column) -> Column:
    """An answered order as this column's own format; null where it was never ambiguous."""
    return F.when(answer == DAY_FIRST, day_first_format).when(answer == MONTH_FIRST, month_first_format)


# Strptime directives and their Java patterns. Adjacent numeric runs need fixed widths.
_JAVA_RUNS = [("%Y%m%d", "yyyyMMdd"), ("%d%m%Y", "ddMMyyyy"), ("%m%d%Y", "MMddyyyy"), ("%H%M%S", "HHmmss")]
_JAVA_PARTS = [
    ("%d", "d"), ("%m", "M"), ("%Y", "yyyy"), ("%y", "yy"), ("%H", "H"), ("%M", "m"), ("%S", "s"),
    ("%b", "MMM"), ("%B", "MMMM"),
]
# The text each directive accepts.
_TEXT_PARTS = [
    ("%d", "(3[01]|[12][0-9]|0[1-9]|[1-9])"), ("%m", "(1[0-2]|0[1-9]|[1-9])"), ("%Y", "[0-9]{4}"),
    ("%y", "[0-9]{2}"), ("%H", "(2[0-3]|[01][0-9]|[0-9])"), ("%M", "([0-5][0-9]|[0-9])"),
    ("%S", "([0-5][0-9]|[0-9])"), ("%b", "[A-Za-z]{3}"), ("%B", "[A-Za-z]{3,9}"),
]
SUPPORTED_FORMAT = r"^(%[dmYyHMSbB]|[-/. :,_]|T)+$"


def _rewrite(fmt: Column, pairs: list[tuple[str, str]]) -> Column:
    for source, target in pairs:
        fmt = F.replace(fmt, F.lit(source), F.lit(target))
    return fmt


def java_pattern(fmt: Column) -> Column:
    """A strptime format as a Spark pattern; null for directives outside the supported set."""
    quoted = F.replace(fmt, F.lit("T"), F.lit("'T'"))
    return F.when(fmt.rlike(SUPPORTED_FORMAT), _rewrite(quoted, _JAVA_RUNS + _JAVA_PARTS))


def _accepted_text(fmt: Column) -> Column:
    dots = F.replace(F.replace(fmt, F.lit("."), F.lit("[.]")), F.lit(" "), F.lit(" +"))
    return F.concat(F.lit("^"), _rewrite(dots, _TEXT_PARTS), F.lit("$"))


PLAIN_SEPARATORS = ("-", "/", ".", ":", ",", "_")


def _is_plain(fmt: Column) -> Column:
    """Day, month and year in any order, with one separator that is no space."""
    sep = F.substring(fmt, 3, 1)
    named = (F.instr(fmt, "%d") > 0) & (F.instr(fmt, "%m") > 0) & ((F.instr(fmt, "%Y") > 0) | (F.instr(fmt, "%y") > 0))
    return (F.length(fmt) == 8) & sep.isin(*PLAIN_SEPARATORS) & (sep == F.substring(fmt, 6, 1)) & named


def _digits(c: Column, least: int, most: int) -> Column:
    return F.length(c).between(least, most) & (F.translate(c, "0123456789", "") == "")


def _from_pieces(text: Column, fmt: Column) -> Column:
    """A plain format by position: no pattern is built or compiled for a row."""
    sep = F.substring(fmt, 3, 1)

    def piece(directive: str) -> Column:
        return F.split_part(text, sep, ((F.instr(fmt, directive) + 2) / 3).cast("int"))

    day, month, short = piece("%d"), piece("%m"), F.instr(fmt, "%y") > 0
    year = F.when(~short, piece("%Y")).when(piece("%y") >= "69", F.concat(F.lit("19"), piece("%y"))).otherwise(F.concat(F.lit("20"), piece("%y")))
    whole = _digits(day, 1, 2) & _digits(month, 1, 2) & _digits(year, 4, 4) & (year != "0000") & (F.length(text) == F.length(day) + F.length(month) + F.length(year) + F.when(short, 0).otherwise(2))
    return F.when(whole, F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date"))


def _from_pattern(text: Column, fmt: Column) -> Column:
    parsed = F.try_to_timestamp(text, java_pattern(fmt)).cast("date")
    two_digit = fmt.contains("%y") & (F.year(parsed) >= 2069)
    fixed = F.when(two_digit, F.add_months(parsed, -1200)).otherwise(parsed)
    return F.when(F.rlike(text, _accepted_text(fmt)), fixed)


def parse_date(c: Column, fmt: Column) -> Column:
    """C4: text under a strptime format as a date; null on any mismatch.

    `%y` follows the POSIX window (69-99 are the 1900s), which Spark's `yy` does not. Formats with month names, times or
    no separator go by a pattern.
    """
    return F.when(_is_plain(fmt), _from_pieces(strip(c), fmt)).otherwise(_from_pattern(F.regexp_replace(strip(c), r"\s+", " "), fmt))


def serial_to_date(c: Column) -> Column:
    """A bare integer in the plausible range as a date."""
    text = F.regexp_replace(strip(c), "^0+(?=[0-9])", "")
    days = F.when(text.rlike("^[0-9]{1,9}$"), text.try_cast("int"))
    return F.when(
        days.between(SERIAL_MIN, SERIAL_MAX), F.date_add(F.lit("1899-12-30").cast("date"), days)
    )


def convert_date(c: Column, fmt: Column) -> Column:
    """C4 and C5 together: `fmt` is a strptime format or the serial marker."""
    return F.when(fmt == EXCEL_SERIAL, serial_to_date(c)).when(fmt.isNotNull(), parse_date(c, fmt))
