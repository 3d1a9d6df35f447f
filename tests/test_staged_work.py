"""Costly expressions are worked out once a row, and only for the rows that need them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldwise.operators import closures, header, shape
from fieldwise.operators import matching as match
from fieldwise.workload import checks, matching

SF = "/root/testdata/sf0.001"


def test_a_wide_table_makes_each_raw_text_once(spark):
    plan = checks.assemble_wide(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("date_format(") == 1


def test_a_region_is_typed_once(spark, frame):
    rows = [("plain", i, ["s", "1"]) for i in range(300)] + [("flipped", 0, ["name", "a", "b"]), ("flipped", 1, ["key", "1", "2"])]
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def kinds(values):
        calls.add(1)
        return ["num" if v.isdigit() else "str" for v in values]

    made = frame(rows, "sheet string, row_idx bigint, v array<string>").withColumn("t", kinds("v"))
    region = made.select("sheet", "row_idx", F.arrays_zip("v", "t").alias("cells"))
    found = shape.classify_shape(region, keys=["sheet"])
    assert {tuple(r) for r in found.collect()} == {("plain", "row_per_record"), ("flipped", "transposed")}
    assert calls.value == len(rows)


def test_label_lists_are_read_once(spark, frame):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(v):
        calls.add(1)
        return v

    labels = {"plain": ["X", "X", "Y"], "clash": ["X", "X (2)", "X"], "near": ["X (2)", "Z", "Z"]}
    rows = [(d, i, v) for d, vs in labels.items() for i, v in enumerate(vs)]
    found = header.disambiguate_labels(frame(rows, "dataset_id string, col_idx int, header string").withColumn("header", seen("header")))
    got = {d: [r.header for r in sorted(found.collect(), key=lambda r: r.col_idx) if r.dataset_id == d] for d in labels}
    assert got == {"plain": ["X", "X (2)", "Y"], "clash": ["X", "X (2)", "X (3)"], "near": ["X (2)", "Z", "Z (2)"]}
    assert calls.value == len(rows)


def test_preselection_collects_no_lists(spark):
    plan = matching.schema_preselect(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_replayed_profiles_stay_dealt(spark, frame):
    columns = frame([("d", 0, "A"), ("d", 1, " a"), ("e", 0, "a")], "dataset_id string, col_idx int, header string")
    entry = "field_mappings array<struct<target_field:string,source_column_normalised:string,source_column_occurrence:int,inferred_value:string>>"
    hits = frame([("d", [("x", "a", 1, None), ("y", "b", 0, None)]), ("e", [("x", "a", 0, None)])], f"dataset_id string, {entry}")
    found = match.replay_profiles(hits, columns)
    assert {(r.dataset_id, r.target_field, r.source_column, r.needs_confirmation) for r in found.collect()} == {("d", "x", " a", True), ("d", "y", None, False), ("e", "x", "a", False)}
    assert found.rdd.getNumPartitions() >= 16


def test_closed_drafts_stay_dealt(spark, frame):
    columns = frame([("d", 0, "A"), ("d", 1, "B")], "dataset_id string, col_idx int, header string")
    rows = [("d", 0, 1, "b", "text", True, "r"), ("d", 1, 1, "again", "text", True, "r"), ("d", 2, 7, "far", "text", True, "r")]
    drafts = frame(rows, "dataset_id string, position int, column_index int, name string, type string, required boolean, reason string")
    found = closures.close_drafts(drafts, columns)
    assert [(r.source_header, r.name) for r in found.collect()] == [("B", "b")]
    assert found.rdd.getNumPartitions() >= 16
