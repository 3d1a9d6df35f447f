"""The records of one file are read by several tasks, and joined with small tables of a known size."""

from __future__ import annotations

from fieldwise.sources.delimited import scan_delimited


def test_rows_of_one_file_are_spread_and_not_gathered_by_file(spark, tmp_path):
    (tmp_path / "one.csv").write_text("id,value\n" + "".join(f"{i},{i}.5\n" for i in range(400)))
    rows = scan_delimited(spark, str(tmp_path)).tables.rows
    assert len(rows.inputFiles()) >= 4
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file_id" not in plan and "SortMergeJoin" not in plan
    assert sorted((r.row_idx, r.cells[0]) for r in rows.collect()) == [(i, str(i)) for i in range(400)]
