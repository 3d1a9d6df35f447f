"""The workbook ladder: from raw cells to tables or questions.

One *state* frame holds a record a sheet: the gate it stands at and, once it may be read, how. Each stage advances the sheets at its gate and
reads the grid rows of those alone; a sheet that cannot pass leaves one question. What a person answered comes first and is never second-guessed:

    sheet    which sheets of a file are read
    layout   what a hint (given, or replayed from a profile) says about the rows
    shape    what the region below the likeliest header looks like
    judge    a callable's verdict on sheets that are still open
    header   which row names the columns

The state frame is an inventory (sheets), settled at each gate; grid rows never are copied into it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EVIDENCE_ROWS, LAYOUT_CONFIRMATION_BAR, LAYOUT_SCHEMA, FieldSet, Tables
from ..operators.common import union_all
from ..operators.header import SHEET_KEY, detect_header, header_questions, type_cells
from ..operators.layout import evidence_window, fence_tables, fences, grid_sizes, layout_from_hints, rejected_index, slice_at_header, unpivot_key_value
from ..operators.matching import replay_hints
from ..operators.seams import guarded
from ..operators.shape import classify_shape
from ..operators.sheets import choose_sheet, rank_sheets
from ..session import settle
from ..sources.frames import grid_from_cells, union_tables
from .pipeline import Review, map_corpus

# Gates at which a sheet may stand when the ladder is done.
READ = ("rows", "pairs", "tables")  # sliced at a header, un-pivoted, cut at fences
OPEN = ("sheet", "layout", "shape", "header")  # each with a question
PASSED_OVER = "passed_over"  # another sheet of the file was chosen

QUESTION_SCHEMA = (
    "file_id string, sheet string, kind string, unsure_about string, reason string, confidence double, proposal string, alternatives array<string>, "
    "answerable_by_hint boolean, evidence_first_row bigint, evidence_rows array<array<string>>"
)
_LAYOUT = ("kind", "confidence", "reasoning", "header_row_index", "first_data_row", "last_data_row", "key_value_blocks", "one_record_per_value_column", "tables")


class Workbook(NamedTuple):
    """What the ladder made of a corpus of sheets; `questions` in one schema, one for each open gate."""

    state: DataFrame  # file_id, sheet, gate, header_row, first_row, last_row
    tables: Tables
    questions: DataFrame
    errors: DataFrame  # file_id, sheet, error


class MappedWorkbook(NamedTuple):
    workbook: Workbook
    review: Review
    questions: DataFrame  # structure, locale and date questions in the same schema


def as_questions(df: DataFrame) -> DataFrame:
    """Questions of any stage in the one schema; what a stage does not say is null."""
    defaults = {name: f"CAST(NULL AS {kind})" for name, kind in (part.split(" ", 1) for part in QUESTION_SCHEMA.split(", "))}
    return df.select(*(F.col(n).alias(n) if n in df.columns else F.expr(d).alias(n) for n, d in defaults.items()))


def _of(grid: DataFrame, sheets: DataFrame) -> DataFrame:
    return grid.join(sheets.select(*SHEET_KEY), SHEET_KEY, "left_semi")


def sheet_gate(grid: DataFrame, hints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, questions, errors): every sheet at `layout` where it is to be read, at `sheet` where its file is undecided, or passed over.

    Sheets that hints name are read, however many of a file; a name the file does not have is an error and chooses nothing. Other files go by P14.
    """
    ranking = settle(rank_sheets(grid))
    named = hints.filter(F.col("sheet").isNotNull()).select(*SHEET_KEY).distinct()
    known = named.join(ranking.select(*SHEET_KEY), SHEET_KEY, "left_semi")
    missing = named.join(ranking.select(*SHEET_KEY), SHEET_KEY, "left_anti")
    errors = missing.select(*SHEET_KEY, F.concat(F.lit("no sheet named '"), F.col("sheet"), F.lit("'")).alias("error"))
    chosen, undecided, _ = choose_sheet(ranking.join(named, "file_id", "left_anti"))
    picked = chosen.unionByName(known).withColumn("_picked", F.lit(True))
    open_files = undecided.select("file_id", F.lit(True).alias("_open"))
    sizes = ranking.groupBy("file_id").agg(F.count("*").alias("n_sheets"))
    gate = F.when(F.col("_picked"), "layout").when(F.col("_open"), "sheet").otherwise(PASSED_OVER)
    state = ranking.select(*SHEET_KEY).join(picked, SHEET_KEY, "left").join(open_files, "file_id", "left").join(sizes, "file_id")
    questions = undecided.select(
        "file_id", F.lit("sheet").alias("kind"), F.lit("which sheet holds the data").alias("unsure_about"), F.lit("several sheets look equally like data").alias("reason"),
        F.lit(0.5).alias("confidence"), F.element_at("candidates", 1).alias("proposal"), F.col("candidates").alias("alternatives"), F.lit(True).alias("answerable_by_hint"),
    )
    return settle(state.select(*SHEET_KEY, gate.alias("gate"), "n_sheets")), as_questions(questions), errors


def verdict_gate(sheets: DataFrame, verdicts: DataFrame, grid: DataFrame, trusted: Column) -> DataFrame:
    """Sheets with a verdict: file_id, sheet, gate, header_row, first_row, last_row and the layout columns.

    A verdict's rows and columns are never trusted: one outside its grid stays at `layout`, as does a kind that cannot be read and a verdict
    that is not `trusted`.
    """
    judged = verdicts.join(sheets.select(*SHEET_KEY), SHEET_KEY, "left_semi").join(grid_sizes(_of(grid, verdicts)), SHEET_KEY)
    header, last = F.col("header_row_index"), F.coalesce("last_data_row", F.col("n_rows") - 1)
    first = F.coalesce("first_data_row", header + 1)
    fits = ~F.coalesce(rejected_index(F.col("n_rows"), F.col("n_cols")), F.lit(True))
    rows = F.coalesce(header.isNotNull() & (first <= last), F.lit(False))
    gate = (
        F.when(~(fits & trusted), "layout")
        .when((F.col("kind") == "row_per_record") & rows, "rows")
        .when((F.col("kind") == "key_value") & (F.size("key_value_blocks") > 0), "pairs")
        .when((F.col("kind") == "multiple_tables") & (F.size("tables") > 0), "tables")
        .otherwise("layout")
    )
    return judged.select(*SHEET_KEY, gate.alias("gate"), header.alias("header_row"), first.alias("first_row"), last.alias("last_row"), *_LAYOUT)


def _layout_questions(stuck: DataFrame, grid: DataFrame) -> DataFrame:
    """A layout that a person has to confirm or correct, with the rows around its header."""
    window = evidence_window(_of(grid, stuck), stuck.select(*SHEET_KEY, F.col("header_row_index").alias("header_row")))
    asked = stuck.join(window, SHEET_KEY, "left")
    return as_questions(asked.select(
        *SHEET_KEY, F.lit("layout").alias("kind"), F.concat(F.lit("layout looks like "), F.col("kind")).alias("unsure_about"), F.col("reasoning").alias("reason"),
        "confidence", F.to_json(F.struct(*_LAYOUT)).alias("proposal"), F.lit(True).alias("answerable_by_hint"), "evidence_first_row", "evidence_rows",
    ))


def _shape_questions(shaped: DataFrame, grid: DataFrame) -> DataFrame:
    """A shape that is no single table, with the first rows of its region; a layout answers it."""
    rows = F.col("row_idx") - F.coalesce(F.col("header_row") + 1, F.lit(0))
    region = grid.join(shaped.select(*SHEET_KEY, "header_row"), SHEET_KEY).filter(rows.between(0, EVIDENCE_ROWS - 1))
    shown = region.groupBy(*SHEET_KEY).agg(F.array_sort(F.collect_list(F.struct("row_idx", F.transform("cells", lambda c: F.coalesce(c["v"], F.lit(""))).alias("cells")))).alias("_r"))
    reason = F.when(F.col("shape") == "unknown", "the sheet holds no table rows").otherwise(F.concat(F.lit("the sheet looks like "), F.col("shape"), F.lit(", which is no single table")))
    asked = shaped.join(shown, SHEET_KEY, "left")
    return as_questions(asked.select(
        *SHEET_KEY, F.lit("shape").alias("kind"), F.col("shape").alias("unsure_about"), reason.alias("reason"), F.lit(0.0).alias("confidence"), F.lit(True).alias("answerable_by_hint"),
        F.coalesce(F.col("header_row") + 1, F.lit(0)).cast("bigint").alias("evidence_first_row"), F.transform("_r", lambda r: r["cells"]).alias("evidence_rows"),
    ))


def read_workbooks(
    cells: DataFrame,
    hints: DataFrame | None = None,
    judge: Callable[[DataFrame], DataFrame] | None = None,
    redact: Callable[[DataFrame], DataFrame] | None = None,
    replayable: tuple[DataFrame, str] | None = None,
) -> Workbook:
    """Raw cells (file_id, sheet, row_idx, col_idx, v, and t where types are native) as tables and questions.

    hints: file_id, sheet, structural_hint; a hint without a sheet holds for whichever sheet of its file is read, unless it names one inside.
    replayable: saved profiles and the field set's signature; a profile whose header row reproduces its column signature answers an open sheet (M7).
    judge: gets the open sheets' grid (as `redact` leaves it) and answers layouts; a judge that fails answers nothing and leaves an error.
    An empty frame gives empty frames; a sheet without cells does not exist.
    """
    spark = cells.sparkSession
    typed = cells if "t" in cells.columns else cells.withColumn("t", F.lit(None).cast("string"))
    grid = grid_from_cells(typed.select(*SHEET_KEY, "row_idx", "col_idx", "v", "t"))
    if "t" not in cells.columns:
        grid = type_cells(grid.withColumn("cells", F.transform("cells", lambda c: c["v"])))
    return climb(settle(grid), spark.createDataFrame([], "file_id string, sheet string, structural_hint struct<sheet:string>") if hints is None else hints, judge, redact, replayable)


def climb(grid: DataFrame, hints: DataFrame, judge, redact, replayable) -> Workbook:
    """The ladder over a settled grid."""
    spark = grid.sparkSession
    hints = hints.withColumn("sheet", F.coalesce("sheet", "structural_hint.sheet"))
    state, questions, errors = sheet_gate(grid, hints)
    questions, errors, done = [questions], [errors], []
    chosen = state.filter(F.col("gate") == "layout").select(*SHEET_KEY, "n_sheets")

    # Layout: what was answered, per sheet before per file.
    answered = None
    if "layout" in hints.select("structural_hint.*").columns:
        own = chosen.join(hints.filter(F.col("sheet").isNotNull()), SHEET_KEY)
        of_file = chosen.join(own.select(*SHEET_KEY), SHEET_KEY, "left_anti").join(hints.filter(F.col("sheet").isNull()).drop("sheet"), "file_id")
        answers = layout_from_hints(own.unionByName(of_file, allowMissingColumns=True)).dropDuplicates(SHEET_KEY)
        answered = settle(verdict_gate(chosen, answers, grid, F.lit(True)))
        done.append(answered)
    unread = chosen if answered is None else chosen.join(answered.select(*SHEET_KEY), SHEET_KEY, "left_anti")

    # Header and shape of what nobody spoke for.
    open_grid = _of(grid, unread)
    detected = settle(detect_header(open_grid))
    region = open_grid.join(detected.select(*SHEET_KEY, F.coalesce("header_row", F.lit(-1)).alias("_h")), SHEET_KEY).filter(F.col("row_idx") > F.col("_h")).drop("_h")
    shaped = detected.join(classify_shape(region, detected), SHEET_KEY)
    gate = F.when(F.col("shape") != "row_per_record", "shape").when(F.col("header_row").isNull() | ~F.col("confident"), "header").otherwise("rows")
    shaped = settle(shaped.withColumn("gate", gate))
    bounds = [(F.col("header_row") + 1).alias("first_row"), (F.col("n_rows") - 1).alias("last_row")]
    stuck = shaped.filter(F.col("gate") != "rows")

    # Open sheets may be answered by a saved profile's hint, then by the judge.
    if replayable is not None:
        profiles, signature = replayable
        asked = stuck.select(*SHEET_KEY, F.lit(signature).alias("field_set_signature"))
        replayed = replay_hints(asked, profiles, _of(grid, stuck)).select(*SHEET_KEY, F.col("header_row").alias("_said"))
        layout = replayed.join(stuck.select(*SHEET_KEY, "n_rows"), SHEET_KEY).filter(F.col("_said") < F.col("n_rows") - 1)
        layout = layout.select(*SHEET_KEY, F.lit("rows").alias("gate"), F.col("_said").alias("header_row"), (F.col("_said") + 1).alias("first_row"), (F.col("n_rows") - 1).alias("last_row"))
        layout = settle(layout)
        done.append(layout)
        stuck = stuck.join(layout.select(*SHEET_KEY), SHEET_KEY, "left_anti")
    if judge is not None:
        shown = _of(grid, stuck)
        given, failed = guarded(judge, shown if redact is None else redact(shown), LAYOUT_SCHEMA, "the layout judge")
        errors.append(failed.select(F.lit(None).cast("string").alias("file_id"), F.lit(None).cast("string").alias("sheet"), "error"))
        sure = (F.col("kind") == "row_per_record") & (F.col("confidence") >= LAYOUT_CONFIRMATION_BAR)
        judged = settle(verdict_gate(stuck, given.dropDuplicates(SHEET_KEY), grid, sure))
        done.append(judged)
        questions.append(_layout_questions(judged.filter(F.col("gate") == "layout"), grid))
        stuck = stuck.join(judged.select(*SHEET_KEY), SHEET_KEY, "left_anti")
    if answered is not None:
        questions.append(_layout_questions(answered.filter(F.col("gate") == "layout"), grid))
    questions.append(_shape_questions(stuck.filter(F.col("gate") == "shape"), grid))
    unsure = header_questions(stuck.filter(F.col("gate") == "header").withColumn("confident", F.lit(False)))
    questions.append(as_questions(unsure.withColumn("proposal", F.col("proposal").cast("string")).withColumn("confidence", F.lit(0.5))))

    narrow = ["gate", "header_row", "first_row", "last_row"]
    by_rule = shaped.filter(F.col("gate") == "rows").select(*SHEET_KEY, "gate", "header_row", *bounds)
    waiting = stuck.select(*SHEET_KEY, "gate", "header_row", *bounds)
    told = union_all([by_rule, waiting, *(d.select(*SHEET_KEY, *narrow) for d in done)])
    final = settle(state.drop("gate").join(told, SHEET_KEY).unionByName(state.filter(F.col("gate") != "layout"), allowMissingColumns=True))
    tables, broken = _tables(grid, final, done)
    return Workbook(final.drop("n_sheets"), tables, union_all(questions), union_all([*errors, broken]))


def _tables(grid: DataFrame, state: DataFrame, done: list[DataFrame]) -> tuple[Tables, DataFrame]:
    """The tables of all sheets that may be read, each way over its own sheets' rows; and the fences that do not fit."""
    rows = state.filter(F.col("gate") == "rows")
    sliced = slice_at_header(_of(grid, rows), rows)
    tagged = rows.select(F.col("file_id").alias("source_file"), "sheet", F.when(F.col("n_sheets") > 1, F.col("sheet")).alias("label"))
    parts = [Tables(sliced.datasets.drop("label").join(tagged, ["source_file", "sheet"]), sliced.columns, sliced.rows)]
    errors = state.limit(0).select(*SHEET_KEY, F.lit("").alias("error"))
    layouts = [d.filter(F.col("gate").isin("pairs", "tables")).select(*SHEET_KEY, "gate", *_LAYOUT) for d in done if "kind" in d.columns]
    if layouts:
        told = union_all(layouts)
        pairs, fenced = told.filter(F.col("gate") == "pairs"), told.filter(F.col("gate") == "tables")
        parts.append(unpivot_key_value(_of(grid, pairs), pairs))
        cut, broken = fence_tables(_of(grid, fenced), fences(fenced))
        parts.append(cut)
        errors = broken.select(*SHEET_KEY, "error")
    return union_tables(*(Tables(p.datasets, p.columns.select("dataset_id", "col_idx", "header"), p.rows) for p in parts)), errors


def separators(hints: DataFrame, datasets: DataFrame) -> DataFrame:
    """The hints' decimal separators per dataset: the sheet's own before its file's."""
    said = hints.select("file_id", F.coalesce("sheet", "structural_hint.sheet").alias("_sheet"), "structural_hint.decimal_separator").filter(F.col("decimal_separator").isNotNull())
    met = datasets.join(said, (datasets["source_file"] == said["file_id"]) & (said["_sheet"].isNull() | (said["_sheet"] == datasets["sheet"])))
    best = F.min_by("decimal_separator", F.struct(F.col("_sheet").isNull(), F.col("decimal_separator"))).alias("decimal_separator")
    return met.groupBy("dataset_id").agg(best)


def map_workbooks(cells: DataFrame, field_set: FieldSet, hints: DataFrame | None = None, judge=None, redact=None, replayable=None, **mapping) -> MappedWorkbook:
    """Raw cells to mapped datasets and one frame of everything that is unsure: sheets, layouts, shapes, headers, locales and dates."""
    book = read_workbooks(cells, hints, judge, redact, replayable)
    tables = Tables(settle(book.tables.datasets), settle(book.tables.columns), book.tables.rows)
    has_separator = hints is not None and "decimal_separator" in hints.select("structural_hint.*").columns
    review = map_corpus(tables, field_set, hints=separators(hints, tables.datasets) if has_separator else None, **mapping)
    places = tables.datasets.select("dataset_id", F.col("source_file").alias("file_id"), "sheet")
    locales = review.locale_questions.join(places, "dataset_id").select(
        *SHEET_KEY, "kind", F.concat(F.lit("decimal separator of "), F.array_join("columns", ", ")).alias("unsure_about"), F.lit("both readings fit every value").alias("reason"),
        F.lit(0.5).alias("confidence"), F.lit(",").alias("proposal"), F.array(F.lit(","), F.lit(".")).alias("alternatives"), F.lit(True).alias("answerable_by_hint"),
    )
    dates = review.date_questions.join(places, "dataset_id").select(
        *SHEET_KEY, F.lit("date_order").alias("kind"), F.concat(F.lit("day or month first in '"), F.col("source_column"), F.lit("'")).alias("unsure_about"),
        F.lit("both orders fit every value").alias("reason"), F.lit(0.5).alias("confidence"), F.col("day_first_format").alias("proposal"),
        F.array("day_first_format", "month_first_format").alias("alternatives"), F.lit(True).alias("answerable_by_hint"),
        F.lit(0).cast("bigint").alias("evidence_first_row"), F.transform("example_values", lambda v: F.array(v)).alias("evidence_rows"),
    )
    return MappedWorkbook(book._replace(tables=tables), review, union_all([book.questions, as_questions(locales), as_questions(dates)]))
