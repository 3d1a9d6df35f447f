"""The workbook ladder, changesets, seams and watched reviews on small inputs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldwise.model import HINT, LAYOUT_SCHEMA
from fieldwise.operators.changes import Dictionary, apply_changes, changeset
from fieldwise.operators.dictionary import ALIASES, FIELDS, SCHEMAS
from fieldwise.operators.seams import guarded
from fieldwise.plans.workbook import read_workbooks
from fieldwise.streaming.pending import Review, current_states, start_pending, watch_pending

CELLS = "file_id string, sheet string, row_idx long, col_idx int, v string, t string"


def cells(spark, sheets):
    """{(file, sheet): rows of values}; numbers are num, None is no cell."""
    rows = [
        (f, s, i, j, str(v), "num" if isinstance(v, (int, float)) else "str")
        for (f, s), grid in sheets.items() for i, line in enumerate(grid) for j, v in enumerate(line) if v is not None
    ]
    return spark.createDataFrame(rows, CELLS)


def hints(spark, rows):
    """(file, sheet, hint as JSON)"""
    df = spark.createDataFrame(rows, "file_id string, sheet string, j string")
    return df.select("file_id", "sheet", F.from_json("j", HINT).alias("structural_hint"))


TABLE = [["id", "name", "value"], *[[k, f"n{k}", k / 2] for k in range(1, 7)]]
BOOK = {
    ("plain", "s"): TABLE,
    ("two", "data"): TABLE, ("two", "notes"): [["see data"]],
    ("twins", "a"): TABLE, ("twins", "b"): TABLE,
    ("down", "s"): [["id", 1, 2], ["name", "x", "y"], ["value", 0.5, 1.5]],
    ("hinted", "s"): [["made by"], ["x", "y", "z"], *TABLE],
    ("wrong", "s"): TABLE,
}


@pytest.fixture(scope="module")
def book(spark):
    said = [
        ("down", None, '{"layout": {"kind": "key_value", "confidence": 1, "key_value_blocks": [{"label_column": 0, "value_columns": [1, 2], "first_row": 0, "last_row": 2}], "one_record_per_value_column": true}}'),
        ("hinted", None, '{"header_row": 2}'),
        ("wrong", None, '{"header_row": 99}'),
        ("plain", "nowhere", '{"header_row": 0}'),
    ]
    return read_workbooks(cells(spark, BOOK), hints(spark, said))


def test_every_sheet_stands_at_one_gate(book):
    got = {(r.file_id, r.sheet): (r.gate, r.header_row) for r in book.state.collect()}
    assert got == {
        ("plain", "s"): ("passed_over", None), ("two", "data"): ("rows", 0), ("two", "notes"): ("passed_over", None), ("twins", "a"): ("sheet", None), ("twins", "b"): ("sheet", None),
        ("down", "s"): ("pairs", None), ("hinted", "s"): ("rows", 2), ("wrong", "s"): ("layout", 99),
    }
    assert [(r.file_id, r.error) for r in book.errors.collect()] == [("plain", "no sheet named 'nowhere'")]
    asked = {(r.file_id, r.kind): r for r in book.questions.collect()}
    assert set(asked) == {("twins", "sheet"), ("wrong", "layout")}
    assert asked["twins", "sheet"].alternatives == ["a", "b"] and asked["wrong", "layout"].answerable_by_hint


def test_tables_come_from_what_may_be_read(book):
    ids = {r.dataset_id: r for r in book.tables.datasets.collect()}
    rows = {}
    for r in book.tables.rows.collect():
        rows.setdefault(ids[r.dataset_id].source_file, {})[r.row_idx] = r.cells
    plain = {k - 1: [str(k), f"n{k}", str(k / 2)] for k in range(1, 7)}
    assert rows == {"two": plain, "hinted": plain, "down": {0: ["1", "x", "0.5"], 1: ["2", "y", "1.5"]}}
    assert {r.source_file: r.label for r in ids.values()} == {"two": "data", "hinted": None, "down": None}


def test_an_empty_corpus_and_a_failing_judge(spark):
    nothing = read_workbooks(cells(spark, BOOK).limit(0))
    assert all(df.count() == 0 for df in (nothing.state, nothing.tables.rows, nothing.questions, nothing.errors))
    parts = {("f", "s"): [*TABLE, [None, None, None], *TABLE][:7] + [["a", "b"], ["c", "d"]]}

    def broken(shown):
        raise TimeoutError("no answer")

    book = read_workbooks(cells(spark, {("m", "s"): [["n", "a", "b", "c"], *[[f"r{k}", k, k + 1, k + 2] for k in range(5)]], **parts}), judge=broken)
    assert {r.file_id: r.gate for r in book.state.collect()}["m"] == "shape"
    assert [r.error for r in book.errors.collect()] == ["the layout judge failed: TimeoutError: no answer"]

    def sure(shown):
        return shown.select("file_id", "sheet").distinct().select("*", F.lit("row_per_record").alias("kind"), F.lit(0.95).alias("confidence"), F.lit(0).cast("bigint").alias("header_row_index"))

    assert {r.file_id: r.gate for r in read_workbooks(cells(spark, {("m", "s"): [["n", "a", "b", "c"], *[[f"r{k}", k, k + 1, k + 2] for k in range(5)]]}), judge=sure).state.collect()} == {"m": "rows"}


def test_a_seam_answers_in_its_schema(spark):
    asked = spark.range(3)
    answers, errors = guarded(lambda df: df.select(F.col("id").cast("int").alias("dataset_id"), F.lit("x").alias("kind")), asked, "dataset_id string, kind string, confidence double", "helper")
    assert sorted(tuple(r) for r in answers.collect()) == [("0", "x", None), ("1", "x", None), ("2", "x", None)] and errors.count() == 0
    answers, errors = guarded(lambda df: df.select(F.raise_error(F.lit("late")).alias("kind")), asked, LAYOUT_SCHEMA, "helper")
    assert answers.count() == 0 and errors.first().error.startswith("helper failed: ")


def test_a_changeset_is_the_step_from_one_version_to_the_next(spark):
    at, gone = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    schemas = spark.createDataFrame([("s", "s", "u", at, 0, None, None)], SCHEMAS)

    def fields(rows):
        return spark.createDataFrame([(i, "s", k, i, None, kind, None, None, True, None, None, None, removed, None) for k, (i, kind, removed) in enumerate(rows)], FIELDS)

    aliases = spark.createDataFrame([("a", "v", "c", "k", "u", at, None, None, 0, None, None)], ALIASES)
    before = Dictionary(schemas, fields([("a", "text", None), ("b", "text", None), ("c", "text", None)]), aliases)
    after = Dictionary(schemas, fields([("a", "text", None), ("b", "number", None), ("c", "text", gone), ("d", "date", None)]), aliases.limit(0))
    changes = changeset(before, after)
    assert {(r.table_name, r.op): r.n for r in changes.groupBy("table_name", "op").agg(F.count("*").alias("n")).collect()} == {
        ("schemas", "keep"): 1, ("aliases", "keep"): 1, ("fields", "keep"): 1, ("fields", "update"): 1, ("fields", "tombstone"): 1, ("fields", "insert"): 1,
    }
    once = apply_changes(before, changes)
    assert sorted(map(tuple, once.fields.collect())) == sorted(map(tuple, after.fields.collect())) and once.aliases.count() == 1
    assert sorted(map(tuple, apply_changes(once, changes).fields.collect())) == sorted(map(tuple, once.fields.collect()))


def test_reviews_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    hour = lambda h: day + dt.timedelta(hours=h)
    files = [
        [("late", "confirmed", 30), ("timely", "confirmed", 5), ("again", "confirmed", 2)],  # confirmations that arrive before what they confirm
        [("late", "opened", 1), ("timely", "opened", 1), ("silent", "opened", 2), ("again", "opened", 1), ("again", "confirmed", 3), ("never", "confirmed", 4)],
        [("open", "opened", 59), ("clock", "opened", 60)],
    ]
    for k, events in enumerate(files):
        spark.createDataFrame([(t, hour(h), kind) for t, kind, h in events], "token string, at timestamp, kind string").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    stream = spark.readStream.schema("token string, at timestamp, kind string").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    opened = stream.filter("kind = 'opened'").select("token", F.col("at").alias("created_at"))
    closed = stream.filter("kind = 'confirmed'").select("token", F.col("at").alias("confirmed_at"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    start_pending(watch_pending(opened, closed), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = {r.token: (r.state, r.confirmed_at) for r in current_states(spark, str(tmp_path / "out")).collect()}
    assert got == {"late": ("late", hour(30)), "timely": ("confirmed", hour(5)), "silent": ("expired", None), "again": ("confirmed", hour(2)), "open": ("live", None)}
    rejects = {(r.token, r.reason) for r in spark.read.parquet(str(tmp_path / "out" / "rejects")).collect()}
    assert rejects == {("late", "late"), ("never", "unknown")}
    assert Review(24, 1).remember == 3_600_000
