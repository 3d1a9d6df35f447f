"""Settled tables and their owner; row and name builders."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from fieldwise.session import settle, workspace
from fieldwise.sinks.export import member_names, safe_names
from fieldwise.sources.frames import grid_from_cells


def test_workspace_removes_what_was_settled_inside(spark):
    with workspace(spark) as folder:
        kept = settle(spark.range(3).select(F.col("id").alias("a")))
        assert kept.count() == 3
        local = folder.removeprefix("file:")
        assert os.listdir(local)
    assert not os.path.exists(local)


def test_grid_rows_fill_gaps(spark):
    cells = spark.createDataFrame(
        [("f", "s", 0, 2, "c", "str"), ("f", "s", 0, 0, "a", "str"), ("f", "s", 1, 1, "b", "num")], "file_id string, sheet string, row_idx long, col_idx int, v string, t string"
    )
    rows = {r.row_idx: [(c.v, c.t) for c in r.cells] for r in grid_from_cells(cells).collect()}
    assert rows == {0: [("a", "str"), (None, "blank"), ("c", "str")], 1: [(None, "blank"), ("b", "num")]}


def one_by_one(names):
    used = []
    for idx, name in enumerate(names):
        chosen = name
        while chosen in used:
            chosen = f"{chosen}_{idx}"
        used.append(chosen)
    return used


def test_safe_names_like_one_by_one(spark):
    for names in (["a", "b", "a", "a"], ["a", "a_2", "a", "a_2"], ["x_1", "x", "x", "x_2_2", "x_2"], ["q"] * 300):
        df = spark.createDataFrame([("f", i, n) for i, n in enumerate(names)], "file_id string, idx int, name string")
        assert [r.safe for r in safe_names(df).orderBy("idx").collect()] == one_by_one(names)


def test_safe_names_of_a_large_file_with_clashes(spark):
    names = ["q"] * 20_000 + [f"q_{k}" for k in range(15_000, 25_000)] + ["a", "a_2", "a"]
    used, expected = set(), []
    for idx, name in enumerate(names):
        while name in used:
            name = f"{name}_{idx}"
        used.add(name)
        expected.append(name)
    df = spark.createDataFrame([("f", i, n) for i, n in enumerate(names)], "file_id string, idx int, name string")
    assert [r.safe for r in safe_names(df).orderBy("idx").collect()] == expected


def test_member_names_of_untitled_rows(spark):
    df = spark.createDataFrame(
        [("f", "s", None, None, "l"), ("f", "s", 0, None, "r1"), ("f", "s", 1, "", "r2"), ("f", "s", 2, "t", "r3"), ("f", "s", 3, "t", "r4"), ("f", "s", 4, "u", "r5")],
        "file_id string, sheet string, table_idx int, title string, label string",
    )
    got = [r.member for r in member_names(df).orderBy(F.col("table_idx").asc_nulls_first()).collect()]
    assert got == ["s", "s — r1", "s — r2", "s — t (r3)", "s — t (r4)", "s — u"]
