"""Dictionaries that many branches read are made once."""

from __future__ import annotations

from fieldwise.workload import governance

SF = "/root/testdata/sf0.001"


def test_branches_read_the_dictionaries_not_the_lines_behind_them(spark):
    master, incoming = governance.dictionaries(spark, SF)
    read = [*master.inputFiles(), *incoming.inputFiles(), *governance.choices(master).inputFiles()]
    assert read and not [f for f in read if "lineitem" in f or f.endswith("part.parquet")]
