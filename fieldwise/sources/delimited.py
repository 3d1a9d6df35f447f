"""Delimited text files as datasets, with named errors instead of exceptions.

Files are read as splittable text, so one multi-gigabyte file is as parallel as many small
ones. What depends on earlier lines of a file (line numbers, open quotes, record numbers)
is computed in blocks; no task holds a whole file. Staged tables in the checkpoint folder (marked
lines, split records, and the small ones of headers and refused files) keep every later branch a plain scan.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_header, strip
from ..model import Tables, dataset_id
from ..operators.common import BLOCK_ROWS, running_parity, union_all
from ..operators.header import disambiguate_labels
from ..session import settle
from .frames import pad_row

# Suffixes, delimiters in order of preference, words that read as missing.
READABLE_SUFFIXES = ("csv",)
DELIMITERS = (",", ";", "\t", "|")
NA_WORDS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

KEY = ["file_id"]


class Scan(NamedTuple):
    """What a scan yields; every frame is lazy."""

    tables: Tables
    errors: DataFrame
    questions: DataFrame
    delimiters: DataFrame


def file_name(file_id: Column) -> Column:
    return F.regexp_extract(file_id, r"([^/]+)$", 1)


def _error(file_id: Column, text: str | Column) -> Column:
    message = F.lit(text) if isinstance(text, str) else text
    return F.concat(F.lit("Cannot ingest "), file_name(file_id), F.lit(": "), message)


def inventory(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file_id of every file, empty ones included: Spark's own file listing, no content read.

    Names only. The listing is the one Spark's file index already keeps on the driver for any scan
    of this path; empty files appear nowhere else, because scans leave them out.
    """
    listed = spark.read.format("binaryFile").load(path).inputFiles()
    names = spark.createDataFrame([(n,) for n in listed], "value string")
    return names.select(F.regexp_replace("value", "^file:/+", "file:/").alias("file_id"))


def classify_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, refused with a named error)."""
    suffix = F.lower(F.regexp_extract("file_id", r"\.([^./]+)$", 1))
    reason = (
        F.when(suffix == "xls", "the legacy workbook format is not supported; save it as .xlsx")
        .when(suffix == "xlsx", "workbooks enter as extracted cells, not as files")
        .otherwise(F.concat(F.lit("unsupported format '."), suffix, F.lit("'")))
    )
    known = suffix.isin(*READABLE_SUFFIXES)
    return files.filter(known), files.filter(~known).select("file_id", _error(F.col("file_id"), reason).alias("error"))


def read_lines(spark: SparkSession, path: str | list[str], glob: str = "*.csv") -> DataFrame:
    """Raw lines of every file with their place: file_id, _start (byte split), _id, valid (UTF-8), text.

    Any of CRLF, LF, CR ends a line. One split of a file is one task, its lines in order.
    """
    return placed_lines(spark.read.option("pathGlobFilter", glob).text(path).select("value", "_metadata"))


def placed_lines(text: DataFrame) -> DataFrame:
    """Lines of a text source (value, _metadata), read or arriving, with their place."""
    return text.select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("file_id"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), F.is_valid_utf8("value").alias("valid"), F.col("value").alias("text"),
    )


def quote_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def mark_lines(raw: DataFrame) -> DataFrame:
    """file_id, line_no, valid, text, is_comment: line numbers and S3 in one blocked pass.

    Ranks and quote parities run inside a byte split; splits are then offset by the totals of the
    few splits before them.
    """
    odd = quote_count(F.col("text")) % 2
    inside = Window.partitionBy("file_id", "_start").orderBy("_id")
    ranked = raw.withColumn("_rank", F.row_number().over(inside) - 1).withColumn(
        "_odd", F.coalesce(F.sum(odd).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    totals = ranked.groupBy("file_id", "_start").agg(F.count("*").alias("_n"), F.sum(odd).alias("_q"))
    before = Window.partitionBy("file_id").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "file_id", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lines"), F.coalesce(F.sum("_q").over(before), F.lit(0)).alias("_quotes")
    )
    placed = ranked.join(offsets, ["file_id", "_start"]).withColumn("line_no", (F.col("_lines") + F.col("_rank")).cast("bigint"))
    text = F.when(F.col("line_no") == 0, F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text"))
    closed = (F.col("_quotes") + F.col("_odd")) % 2 == 0
    return placed.select(
        "file_id", "line_no", "valid", text.alias("text"), (closed & strip(F.col("text")).startswith("#")).alias("is_comment"),
    )


def strip_comment_lines(lines: DataFrame, keys: list[str] = KEY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """S3: adds `is_comment`: first visible character `#` while no quoted cell is open.

    The quote state toggles on every line with an odd number of quotes, comment lines included.
    """
    state = running_parity(lines, keys, "line_no", quote_count(F.col("text")) % 2 == 1, "_open", block_rows)
    return state.withColumn("is_comment", ~F.col("_open") & strip(F.col("text")).startswith("#")).drop("_open")


def detect_delimiter(kept: DataFrame, hints: DataFrame | None = None, keys: list[str] = KEY) -> DataFrame:
    """Keys, delimiter. The candidate whose commonest per-line count is steadiest, then largest.

    Counts ignore quoted stretches; a given answer wins; text without any candidate falls back to a comma.
    """
    bare = F.regexp_replace("text", '"[^"]*"', "")
    counts = F.array(*[
        F.struct(F.lit(i).alias("i"), (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias("n"))
        for i, d in enumerate(DELIMITERS)
    ])
    seen = kept.filter(strip(F.col("text")) != "").select(*keys, F.inline(counts)).groupBy(*keys, "i", "n").agg(F.count("*").alias("lines"))
    per = seen.groupBy(*keys, "i").agg(
        F.sum("lines").alias("total"),
        F.max(F.when(F.col("n") > 0, F.struct("lines", "n"))).alias("mode"),
    ).filter(F.col("mode").isNotNull())
    ranked = per.groupBy(*keys).agg(
        F.max(F.struct((F.col("mode.lines") / F.col("total")).alias("steady"), F.col("mode.n").alias("n"), (-F.col("i")).alias("neg"))).alias("best")
    )
    names = F.array(*[F.lit(d) for d in DELIMITERS])
    found = ranked.select(*keys, F.element_at(names, 1 - F.col("best.neg")).alias("delimiter"))
    result = kept.select(*keys).distinct().join(found, keys, "left")
    if hints is not None:
        result = result.join(hints.select(*keys, F.col("delimiter").alias("_hint")), keys, "left").withColumn(
            "delimiter", F.coalesce("_hint", "delimiter")
        ).drop("_hint")
    return result.withColumn("delimiter", F.coalesce("delimiter", F.lit(",")))


def _class(delimiter: Column) -> Column:
    return F.concat(F.lit("\\"), F.when(delimiter == "\t", F.lit("t")).otherwise(delimiter))


def raw_fields(text: Column, delimiter: Column) -> Column:
    """A record's fields as written, quotes kept. A quote counts only at the start of a field."""
    d = _class(delimiter)
    pattern = F.concat(
        d, F.lit('("[^"]*+(?:""[^"]*+)*+"[^'), d, F.lit("]*|[^"), d, F.lit("]*)"),
    )
    return F.regexp_extract_all(F.concat(delimiter, text), pattern, F.lit(1))


_QUOTED = '(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$'
_CLOSED = '^"[^"]*+(?:""[^"]*+)*+"'


def unquote(field: Column) -> Column:
    inner = F.replace(F.regexp_extract(field, _QUOTED, 1), F.lit('""'), F.lit('"'))
    return F.when(field.startswith('"') & field.rlike(_CLOSED), F.concat(inner, F.regexp_extract(field, _QUOTED, 2))).otherwise(field)


def split_fields(text: Column, delimiter: Column) -> Column:
    """A record's field values."""
    fields = raw_fields(text, delimiter)
    return F.when(text.contains('"'), F.transform(fields, unquote)).otherwise(F.split(text, _class(delimiter), -1))


def _opens(text: Column, delimiter: Column) -> Column:
    """Whether a line begun outside quotes ends inside them."""
    return F.exists(raw_fields(text, delimiter), lambda f: f.startswith('"') & ~f.rlike(_CLOSED))


def _after_open(text: Column, delimiter: Column) -> Column:
    """The same for a line begun inside quotes: find the closing quote, then read on from there."""
    rest = F.regexp_extract(text, '(?s)^[^"]*+(?:""[^"]*+)*+"(.*)$', 1)
    closes = text.rlike('^[^"]*+(?:""[^"]*+)*+"')
    return F.when(closes, _opens(F.concat(F.lit("x"), rest), delimiter)).otherwise(F.lit(True))


def _state(start: Column, last: Column, swaps: Column) -> Column:
    """State after `swaps` toggles since the last row that fixed it, else since the start."""
    return F.when(last.isNotNull(), (last["set"].cast("int") + swaps - last["swaps"]) % 2 == 1).otherwise(
        (start.cast("int") + swaps) % 2 == 1
    )


def _run_states(df: DataFrame, window: Window, after_false: Column, after_true: Column, prefix: str) -> DataFrame:
    """Adds `<prefix>_last` and `<prefix>_swaps`: what the rows before this one do to a two-state machine.

    A row either fixes the next state or toggles it, so a prefix is its last fixing row plus toggles since.
    """
    swaps, last = f"{prefix}_swaps", f"{prefix}_last"
    toggles = F.when(after_false & ~after_true, 1).otherwise(0)
    counted = df.withColumn(swaps, F.coalesce(F.sum(toggles).over(window), F.lit(0)))
    entry = F.when(after_false == after_true, F.struct(after_false.alias("set"), F.col(swaps).alias("swaps")))
    return counted.withColumn(f"{prefix}_entry", entry).withColumn(last, F.last(f"{prefix}_entry", ignorenulls=True).over(window)).drop(f"{prefix}_entry")


def place_records(lines: DataFrame, keys: list[str] = KEY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds record_no, starts_inside, ends_inside to lines (keys, line_no, text, delimiter).

    Each block of lines is worked out for both possible quote states at its start; block ends are
    chained over the few blocks of a file, and each line then takes the case that applies.
    """
    quoted = F.col("text").contains('"')
    staged = lines.withColumn("_b", F.floor(F.col("line_no") / block_rows)).withColumn(
        "_f", F.when(quoted, _opens(F.col("text"), F.col("delimiter"))).otherwise(F.lit(False))
    ).withColumn("_t", F.when(quoted, _after_open(F.col("text"), F.col("delimiter"))).otherwise(F.lit(True)))
    order = Window.partitionBy(*keys, "_b").orderBy("line_no")
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    run = _run_states(staged, prior, F.col("_f"), F.col("_t"), "_r")
    cases = {"0": F.lit(False), "1": F.lit(True)}
    for c, start in cases.items():
        run = run.withColumn(f"_in{c}", _state(start, F.col("_r_last"), F.col("_r_swaps"))).withColumn(
            f"_out{c}", F.when(F.col(f"_in{c}"), F.col("_t")).otherwise(F.col("_f"))
        )
    for c in cases:
        run = run.withColumn(f"_n{c}", F.sum((~F.col(f"_in{c}")).cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = run.groupBy(*keys, "_b").agg(
        F.max_by("_out0", "line_no").alias("_e0"), F.max_by("_out1", "line_no").alias("_e1"),
        F.max("_n0").alias("_m0"), F.max("_n1").alias("_m1"),
    )
    chain = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    started = _run_states(blocks, chain, F.col("_e0"), F.col("_e1"), "_c").withColumn("_s", _state(F.lit(False), F.col("_c_last"), F.col("_c_swaps")))
    starts = started.select(
        *keys, "_b", "_s", F.coalesce(F.sum(F.when(F.col("_s"), F.col("_m1")).otherwise(F.col("_m0"))).over(chain), F.lit(0)).alias("_offset")
    )
    pick = lambda name: F.when(F.col("_s"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    return run.join(starts, [*keys, "_b"]).select(
        *lines.columns, (F.col("_offset") + pick("_n") - 1).alias("record_no"), pick("_in").alias("starts_inside"), pick("_out").alias("ends_inside"),
    )


def join_records(placed: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Records (keys, record_no, delimiter, text): lines of one quoted cell joined, all others passed through."""
    several = F.col("starts_inside") | F.col("ends_inside")
    single = placed.filter(~several).select(*keys, "record_no", "delimiter", "text")
    joined = (
        placed.filter(several).groupBy(*keys, "record_no", "delimiter")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("_l"))
        .select(*keys, "record_no", "delimiter", F.array_join(F.transform("_l", lambda x: x["text"]), "\n").alias("text"))
    )
    return single.unionByName(joined)


def guard_dropped_lines(dropped: DataFrame, widths: DataFrame) -> DataFrame:
    """Files where a dropped `#` line splits into exactly the table's own column count.

    widths: file_id, delimiter, n_cols.
    """
    split = dropped.join(widths.filter(F.col("n_cols") > 1), KEY)
    same = F.size(split_fields(F.col("text"), F.col("delimiter"))) == F.col("n_cols")
    return split.filter(same).select("file_id").distinct().select(
        "file_id", _error(F.col("file_id"), "a line starting with '#' has as many columns as the table, so it may be its header").alias("error")
    )


def scan_delimited(
    spark: SparkSession,
    path: str | list[str],
    hints: DataFrame | None = None,
    na_words: tuple[str, ...] = NA_WORDS,
) -> Scan:
    """Every readable file below `path` as a dataset, every other one as an error row.

    `hints` is (file_id, delimiter). Marked lines, split records, headers and refused files are each worked out once and written
    as columns into the checkpoint folder; everything returned is lazy over those tables.
    """
    return scan_lines(read_lines(spark, path), inventory(spark, path), hints, na_words)


def scan_lines(raw: DataFrame, files: DataFrame | None = None, hints: DataFrame | None = None, na_words: tuple[str, ...] = NA_WORDS) -> Scan:
    """S1, S2 over lines with their place; `files` is the inventory (the files that have lines, where none is given)."""
    lines = settle(mark_lines(raw))
    readable, refused = classify_files(lines.select("file_id").distinct() if files is None else files)
    facts = lines.groupBy(*KEY).agg(
        F.bool_or(~F.col("valid")).alias("_garbled"),
        F.count_if(~F.col("is_comment") & (strip(F.col("text")) != "")).alias("_n"),
    )
    judged = readable.join(facts, KEY, "left")
    garbled = judged.filter("_garbled").select("file_id", _error(F.col("file_id"), "its bytes are no UTF-8").alias("error"))
    empty = judged.filter(~F.coalesce("_garbled", F.lit(False)) & (F.coalesce("_n", F.lit(0)) == 0)).select(
        "file_id", _error(F.col("file_id"), "it holds no line of data").alias("error")
    )
    usable = facts.filter(~F.col("_garbled") & (F.col("_n") > 0)).select("file_id")
    kept = lines.filter(~F.col("is_comment")).select("file_id", "line_no", "text")
    delimiters = detect_delimiter(kept, hints)
    ready = kept.join(delimiters.join(usable, KEY, "left_semi"), KEY)
    placed = place_records(ready)
    ends = placed.groupBy(*KEY).agg(F.max_by("ends_inside", "line_no").alias("_open"))
    whole = placed.join(ends.filter(~F.col("_open")), KEY, "left_semi")
    tasks = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parsed = settle(join_records(whole).select(
        "file_id", "record_no", "delimiter", (strip(F.col("text")) == "").alias("blank"),
        split_fields(F.col("text"), F.col("delimiter")).alias("cells"),
    ).repartition(tasks, "file_id", "record_no"))  # few bytes, much work: the records of one file are read by many tasks
    unclosed = usable.join(parsed.select("file_id").distinct(), KEY, "left_anti").select(
        "file_id", _error(F.col("file_id"), "a quoted cell is never closed").alias("error")
    )
    first = parsed.filter(~F.col("blank")).groupBy(*KEY).agg(F.min("record_no").alias("_header"))
    # One row a file. Its true size is known before rows are joined with it, so the rows of few large files stay where they were read.
    heads = settle(parsed.join(first, KEY).filter(F.col("record_no") == F.col("_header")).select(
        "file_id", "_header", "delimiter", F.col("cells").alias("names"), F.size("cells").alias("n_cols")
    ))
    data = parsed.join(heads.select("file_id", "_header", "n_cols"), KEY).filter(F.col("record_no") > F.col("_header"))
    excess = F.when(~F.col("blank"), F.size("cells") - F.col("n_cols"))
    widths = data.groupBy(*KEY).agg(
        F.count_if(~F.col("blank")).alias("_n"), F.count_if(excess > 0).alias("_wide"), F.count_if(excess == 1).alias("_one"),
        F.min(F.when(F.col("blank"), F.col("record_no"))).alias("_gap"),
        F.max(F.when(~F.col("blank"), F.col("record_no"))).alias("_last"),
    )
    ragged = widths.filter(F.col("_wide") > 0).select(
        "file_id",
        _error(
            F.col("file_id"),
            F.when(F.col("_one") == F.col("_n"), "each row has one more value than the header has names")
            .otherwise("some rows have more values than the header has names"),
        ).alias("error"),
    )
    guarded = guard_dropped_lines(lines.filter("is_comment"), heads.select("file_id", "delimiter", "n_cols"))
    errors = union_all([refused, garbled, empty, unclosed, ragged, guarded])
    bad = settle(ragged.select("file_id").unionByName(guarded.select("file_id")).distinct())
    ident = dataset_id(F.col("file_id"), F.lit(None).cast("string"), F.lit(0))
    good_heads = heads.join(bad, KEY, "left_anti")
    columns = disambiguate_labels(
        good_heads.select(ident.alias("dataset_id"), F.posexplode("names").alias("col_idx", "raw")).select(
            "dataset_id", "col_idx", clean_header(F.col("raw")).alias("header")
        ),
        style="dot",
    )
    missing = F.array(*[F.lit(w) for w in na_words]).cast("array<string>")
    rows = data.filter(~F.col("blank")).join(bad, KEY, "left_anti").select(
        ident.alias("dataset_id"), (F.col("record_no") - F.col("_header") - 1).alias("row_idx"),
        pad_row(F.transform("cells", lambda c: F.when(F.array_contains(missing, c), "").otherwise(c)), F.col("n_cols")).alias("cells"),
    )
    datasets = good_heads.select(
        ident.alias("dataset_id"), F.col("file_id").alias("source_file"), file_name(F.col("file_id")).alias("sheet"),
        F.lit(0).alias("table_idx"), file_name(F.col("file_id")).alias("origin_sheet"), F.lit(None).cast("string").alias("label"),
    )
    questions = widths.filter(F.col("_gap") < F.col("_last")).select(
        ident.alias("dataset_id"), F.lit("shape").alias("kind"), F.lit("multiple_tables").alias("unsure_about"),
        F.lit("blank lines part the file; it may hold several tables").alias("reason"),
    )
    return Scan(Tables(datasets, columns, rows), errors, questions, delimiters)
