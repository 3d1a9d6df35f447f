"""Matching, closures, dictionary lifecycle, date decisions, the gate, streams."""

from __future__ import annotations

import datetime as dt
import itertools
import os

import pytest
from pyspark.sql import functions as F

from fieldwise.functions.text import optimal_alignment
from fieldwise.model import Field, FieldSet, Tables, mapping_columns
from fieldwise.operators import closures, convert, dictionary, evidence, matching, near, validate
from fieldwise.plans import pipeline
from fieldwise.workload import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def corpus(spark, headers, rows, name="d"):
    datasets = spark.createDataFrame([(name, f"{name}.csv", name, 0, name, None)], "dataset_id string, source_file string, sheet string, table_idx int, origin_sheet string, label string")
    columns = spark.createDataFrame([(name, i, h) for i, h in enumerate(headers)], "dataset_id string, col_idx int, header string")
    data = spark.createDataFrame([(name, i, r) for i, r in enumerate(rows)], "dataset_id string, row_idx bigint, cells array<string>")
    return Tables(datasets, columns, data)


def mapped(spark, pairs, name="d"):
    df = spark.createDataFrame([(name, f, c) for f, c in pairs], "dataset_id string, target_field string, source_column string")
    return df.select(*mapping_columns(source_column=F.col("source_column"), confidence=F.lit(1.0)))


# ---- date decisions ---------------------------------------------------------------------------

AMBIGUOUS = ["03/04/2025", "05/06/2025"]
CASES = [
    # values, declared, answer, resolved format, conflict, contradiction
    (["13/04/2025", "05/06/2025"], None, None, "%d/%m/%Y", False, False),
    (["13/04/2025"], "%d-%m-%Y", None, "%d/%m/%Y", False, False),
    (["13/04/2025"], "%m/%d/%Y", None, None, False, True),
    (["45000", "45001"], "%d/%m/%Y", None, "excel_serial", False, False),
    (AMBIGUOUS, None, None, None, True, False),
    (AMBIGUOUS, None, "month_first", "%m/%d/%Y", False, False),
    (AMBIGUOUS, "%d/%m/%Y", None, "%d/%m/%Y", False, False),
    (AMBIGUOUS, "%d-%m-%Y", None, None, True, True),
    (AMBIGUOUS, "%d-%m-%Y", "day_first", "%d/%m/%Y", False, False),
    (AMBIGUOUS + ["n/a"], "%d/%m/%Y", None, None, True, True),
    (["03/04/05"], "%y/%m/%d", None, "%y/%m/%d", False, False),
    (["13/14/2025", "14/13/2025"], "%d/%m/%Y", None, None, False, False),
    (["hello", ""], None, None, None, False, False),
    (["1/2/25", " "], None, "day_first", "%d/%m/%y", False, False),
    (["2025-01-05", "20250106"], None, None, None, False, False),
]


def test_date_decision_table(spark):
    fields = FieldSet("f", tuple(Field(f"f{i}", "date", date_format=c[1]) for i, c in enumerate(CASES)))
    height = max(len(c[0]) for c in CASES)
    rows = [[c[0][i] if i < len(c[0]) else "" for c in CASES] for i in range(height)]
    tables = corpus(spark, [f"c{i}" for i in range(len(CASES))], rows)
    mappings = mapped(spark, [(f"f{i}", f"c{i}") for i in range(len(CASES))])
    answers = spark.createDataFrame([("d", f"f{i}", c[2]) for i, c in enumerate(CASES) if c[2]], "dataset_id string, target_field string, order string")
    formats, conflicts, contradictions = convert.resolve_date_formats(tables.rows, tables.columns, mappings, fields.frame(spark), answers)
    resolved = {r.target_field: r.date_format for r in formats.collect()}
    asked = {r.target_field: r for r in conflicts.collect()}
    against = {r.target_field: r.example_value for r in contradictions.collect()}
    for i, (values, _, _, fmt, conflict, contradiction) in enumerate(CASES):
        name = f"f{i}"
        assert resolved.get(name) == fmt, (i, resolved.get(name))
        assert (name in asked, name in against) == (conflict, contradiction), i
        if contradiction:
            assert against[name] == values[0]
    assert asked["f4"].example_values == AMBIGUOUS and asked["f4"].ambiguous_row_count == 2
    assert (asked["f4"].day_first_format, asked["f4"].month_first_format) == ("%d/%m/%Y", "%m/%d/%Y")


def test_long_and_wide_forms_agree_and_row_order_does_not_matter(spark):
    headers = ["a", "b", "c", "d"]
    rows = [["1,5", "03/04/2025", "x", "1.234"], ["2,25", "13/04/2025", "", "5,678"], ["7", "", "y", "9"]] * 5
    tables = corpus(spark, headers, rows)
    shuffled = tables.rows.repartition(7).orderBy(F.rand(3))
    for frame in (tables.rows, shuffled):
        got = {r.col_idx: r.locale for r in evidence.classify_locale(frame).collect()}
        orders = {r.col_idx: r.order for r in evidence.classify_date_order(frame).collect()}
        assert got == {0: "decimal_comma", 1: "non_numeric", 2: "non_numeric", 3: "ambiguous"}
        assert orders[1] == "day_first"
    wide = tables.rows.select("row_idx", *[F.element_at("cells", i + 1).alias(h) for i, h in enumerate(headers)])
    assert {r.col_idx: r.locale for r in evidence.wide_locales(wide, headers).collect()} == got
    assert {r.col_idx: r.order for r in evidence.wide_date_orders(wide, headers, F.col("row_idx")).collect()} == orders


# ---- matching ---------------------------------------------------------------------------------


def test_near_pairs_against_all_pairs(spark):
    words = ["test", "tset", "tes", "result", "results", "reuslt", "rsult", "unit", "units", "unti", "ab", "ba", "abc", "acb", "concentration", "cocnentratoin", "value", "vlaue"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {(r.needle, r.known, r.edits) for r in near.near_pairs(df.select(F.col("w").alias("needle")), df.select(F.col("w").alias("known"))).collect()}
    expected = set()
    for a, b in itertools.product(words, words):
        edits = optimal_alignment(a, b)
        if edits <= 2 and edits <= 0.34 * len(b) and int(0.34 * len(b)) >= 1:
            expected.add((a, b, edits))
    assert got == expected


def test_near_pairs_of_long_headers(spark):
    """A header of a thousand characters, its edits anywhere, swaps across segment borders included."""
    base = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(1000))
    spoiled = [base[:k] + base[k + 1] + base[k] + base[k + 2 :] for k in (0, 199, 200, 399, 998) if base[k] != base[k + 1]]
    spoiled += [base[1:], base[:-1], base + "x", "x" + base[:500] + "y" + base[500:], base[:10] + base[12:], base[:600] + "##" + base[602:]]
    needles = spark.createDataFrame([(n,) for n in [*spoiled, base[:400] + base[403:], base[::-1]]], "needle string")
    got = {(r.needle, r.edits) for r in near.near_pairs(needles, spark.createDataFrame([(base,)], "known string")).collect()}
    assert got == {(n, optimal_alignment(n, base)) for n in spoiled}
    keys = spark.createDataFrame([(base,)], "w string").select(F.size(near.needle_segments(F.col("w"))), F.size(near.known_segments(F.col("w")))).first()
    assert keys[0] <= 105 and keys[1] == 5


def test_near_match_refuses_ties_and_covered_fields(spark):
    fields = spark.createDataFrame([("s", 0, "result"), ("s", 1, "resulk"), ("s", 2, "units"), ("s", 3, "analyte")], "schema_name string, pos int, name string")
    columns = spark.createDataFrame([("d", 0, "Resulx"), ("d", 1, "Untis"), ("d", 2, "Analyte"), ("d", 3, "Analytes"), ("d", 4, "")], "dataset_id string, col_idx int, header string")
    index = matching.alias_index(fields, None)
    got = near.near_matches(columns, index, matching.covered_fields(columns, index)).collect()
    assert [(r.header, r.field_name, r.edits) for r in got] == [("Untis", "units", 1)]


def test_colliding_aliases_match_nothing(spark):
    fields = spark.createDataFrame([("s", 0, "compound_id"), ("s", 1, "name")], "schema_name string, pos int, name string")
    aliases = spark.createDataFrame([("s", "name", "Compound ID"), ("s", "name", "Label")], "schema_name string, field_name string, source_column string")
    index = {r.norm: r.field_name for r in matching.alias_index(fields, aliases).collect()}
    assert index == {"compound_id": "compound_id", "compound id": None, "name": "name", "label": "name"}


def test_signature_ignores_order_and_case_but_counts_duplicates(spark):
    lists = {"a": ["Straße", "X"], "b": ["x ", "STRASSE"], "c": ["x", "strasse", "x"]}
    rows = [(k, i, h) for k, hs in lists.items() for i, h in enumerate(hs)]
    got = {r.dataset_id: r.column_signature for r in matching.column_signature(spark.createDataFrame(rows, "dataset_id string, col_idx int, header string")).collect()}
    assert got["a"] == got["b"] != got["c"]


def test_draft_closure_against_plain_loop(spark):
    drafts = [(0, 1, "a"), (1, 1, "b"), (2, 2, "a"), (3, 9, "c"), (4, 0, " "), (5, 0, "d"), (6, 2, "e"), (7, -1, "f")]
    df = spark.createDataFrame([("d", p, i, n, "text", True, "") for p, i, n in drafts], "dataset_id string, position int, column_index int, name string, type string, required boolean, reason string")
    columns = spark.createDataFrame([("d", i, h) for i, h in enumerate("xyz")], "dataset_id string, col_idx int, header string")
    got = closures.close_drafts(df, columns).orderBy("position").collect()
    assert [(r.source_header, r.name) for r in got] == [("y", "a"), ("x", "d"), ("z", "e")]


def test_profile_round_trip_replays_duplicates_with_a_flag(spark):
    columns = spark.createDataFrame([("d", i, h) for i, h in enumerate(["Id", "Unit", "unit "])], "dataset_id string, col_idx int, header string")
    mappings = mapped(spark, [("key", "Id"), ("unit", "unit "), ("lab", None)]).withColumn("inferred_value", F.when(F.col("target_field") == "lab", "north"))
    hits = matching.stored_mapping(mappings, columns)
    again = spark.createDataFrame([("d", i, h) for i, h in enumerate(["UNIT", "ID", "Unit"])], "dataset_id string, col_idx int, header string")
    got = {r.target_field: (r.source_column, r.needs_confirmation, r.inferred_value) for r in matching.replay_profiles(hits, again).collect()}
    assert got == {"key": ("ID", False, None), "unit": ("Unit", True, None), "lab": (None, False, "north")}


# ---- dictionary -------------------------------------------------------------------------------


def test_alias_tombstones_block_seeding_but_not_adding(spark):
    at = dt.datetime(2024, 1, 1)
    fields = spark.createDataFrame([("f", "s", 0, "key", None, None, None, None, True, None, None, None, None, None)], dictionary.FIELDS)
    stored = spark.createDataFrame([("f", "v", "c", "manual", "ann", at, None, None, 0, at, "ann")], dictionary.ALIASES)
    incoming = spark.createDataFrame(
        [("f", "v", "c", "manual", "bob", at, None, None, 1), ("gone", "v", "c", "manual", "bob", at, None, None, 2)],
        "field_id string, vendor string, source_column string, provenance_kind string, provenance_actor string, created_at timestamp, confidence double, note string, seq bigint",
    )
    added, errors = dictionary.add_aliases(stored, incoming, fields)
    assert added.count() == 2 and errors.count() == 1
    seeded, inserted = dictionary.seed_aliases(stored, incoming, fields)
    assert seeded.count() == 1 and inserted.count() == 0
    again, _ = dictionary.add_aliases(added, incoming.withColumn("provenance_actor", F.lit("eve")), fields)
    assert {r.provenance_actor for r in again.filter("removed_at is null").collect()} == {"bob"}


def test_malformed_maps_are_error_rows(spark):
    maps = spark.createDataFrame(
        [("ok", '{"name":"s","fields":[{"name":"a","min":1}]}'), ("nameless", '{"fields":[]}'), ("shape", '{"name":"s","fields":"x"}'), ("field", '{"name":"s","fields":[{"type":"text"}]}'), ("text", "nope")],
        "map_id string, envelope string",
    )
    fields, errors = dictionary.read_master_maps(maps)
    assert [r.map_id for r in fields.collect()] == ["ok"]
    assert {r.map_id for r in errors.collect()} == {"nameless", "shape", "field", "text"}


# ---- gate -------------------------------------------------------------------------------------

FIELDS = FieldSet("lab", (
    Field("id", "integer"), Field("kind", "text", allowed_values=("IC50", "Ki")), Field("value", "number", min=0.0, max=1000.0),
    Field("day", "date"), Field("unit", "text", unit="nM", required=False),
))
HEADERS = ["id", "kind", "value", "day", "unit"]
GOOD = [["1", "ic50", "1,5", "13/04/2025", "nM"], ["2", "Ki", "12,25", "14/04/2025", " nM "]]


def test_confirm_gate(spark):
    pairs = [(f, f) for f in FIELDS.names]
    now = F.lit("2024-01-01 00:00:00")
    good = pipeline.confirm(*_gate(spark, GOOD), mapped(spark, pairs), FIELDS, now)
    assert good.rejected.count() == 0
    row = good.tidy.orderBy("row_idx").first()
    assert (row.id, row.kind, row.value, row.day, row.unit) == (1, "ic50", 1.5, dt.date(2025, 4, 13), "nM")
    assert good.manifests.first().source_columns == HEADERS
    for bad in (["x", "Ki", "1,5", "15/04/2025", "nM"], ["3", "Kd", "1,5", "15/04/2025", "nM"], ["3", "Ki", "nan", "15/04/2025", "nM"], ["3", "Ki", "1001,5", "15/04/2025", "nM"], ["2,5", "Ki", "1,5", "15/04/2025", "uM"]):
        outcome = pipeline.confirm(*_gate(spark, [*GOOD, bad]), mapped(spark, pairs), FIELDS, now)
        assert outcome.tidy.count() == 0 and outcome.rejected.count() == 1, bad
    missing = pipeline.confirm(*_gate(spark, GOOD), mapped(spark, pairs[:-1]), FIELDS, now)
    assert missing.tidy.count() == 0 and "unit" in missing.rejected.first().reason


def _gate(spark, rows):
    tables = corpus(spark, HEADERS, rows)
    return tables, evidence.annotate_locales(tables.columns, tables.rows)


def test_flags_are_never_cleared(spark):
    tables, columns = _gate(spark, GOOD)
    edited = mapped(spark, [(f, f) for f in FIELDS.names]).withColumn("needs_confirmation", F.col("target_field") == "id")
    checked = validate.validate(edited, columns, tables.rows, FIELDS.frame(spark))
    assert {r.target_field for r in checked.filter("needs_confirmation").collect()} >= {"id"}


# ---- every query against its SQL --------------------------------------------------------------

DEFAULT = ["locale_classify", "date_order", "fence_tables", "alias_first_write", "schema_preselect", "sheet_rank", "pending_stream", "export_tidy"]
NAMES = sorted(ORACLES) if os.environ.get("FIELDWISE_ALL_QUERIES") else DEFAULT


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    cursor = con.execute(ORACLES[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == names
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    ours = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    theirs = sorted(repr(tuple(plain(r[found.index(c)]) for c in names)) for r in cursor.fetchall())
    assert ours == theirs


def test_every_registered_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
