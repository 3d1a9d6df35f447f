"""Headers, shapes, layouts, sheets on hand-built grids."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fieldwise.model import LAYOUT_SCHEMA
from fieldwise.operators import header, layout, shape, sheets
from fieldwise.operators.common import running_parity, running_sum


def grid(spark, book):
    """{sheet: [[cell, ...], ...]} as grid rows; Python types give the cell types."""

    def cell(v):
        if v is None:
            return (None, "blank")
        if isinstance(v, bool):
            return (str(v), "bool")
        return (str(v), "num" if isinstance(v, (int, float)) else "str")

    rows = [("book", name, i, [cell(c) for c in row]) for name, lines in book.items() for i, row in enumerate(lines)]
    return spark.createDataFrame(rows, "file_id string, sheet string, row_idx bigint, cells array<struct<v:string,t:string>>")


BANNER = [["Report", None, None], [None, None, None], ["Compound ID", "Result", "Units"], ["A1", 1.5, "nM"], ["A2", 2, "nM"], ["A3", 3.25, "uM"]]


def test_header_under_banner(spark):
    got = header.detect_header(grid(spark, {"s": BANNER})).select("header_row", "confident").first()
    assert tuple(got) == (2, True)


def test_header_tie_is_not_confident_and_asks(spark):
    flat = [["a", "b"], ["c", "d"], ["e", "f"], ["g", "h"]]
    detected = header.detect_header(grid(spark, {"s": flat}))
    assert tuple(detected.select("header_row", "confident").first()) == (0, False)
    question = header.header_questions(detected).first()
    assert question.proposal == 0 and question.evidence_rows == flat


def test_last_row_never_scores_and_single_candidate_is_confident(spark):
    got = header.detect_header(grid(spark, {"one": [["a", "b"], [1, 2]], "lone": [["a"]]})).select("sheet", "header_row", "confident").collect()
    assert {tuple(r) for r in got} == {("one", 0, True), ("lone", None, False)}


def reference_labels(labels):
    """Plain left-to-right numbering with skipping, as the expected outcome."""
    taken, seen, out = set(), {}, []
    for label in labels:
        if not label:
            out.append("")
            continue
        n = seen.get(label, 0) + 1
        while (name := label if n == 1 else f"{label} ({n})") in taken:
            n += 1
        seen[label] = n
        taken.add(name)
        out.append(name)
    return out


def test_disambiguation_against_plain_python(spark):
    rng = random.Random(3)
    pool = ["X", "X (2)", "X (3)", "Y", "", "Y (2)"]
    lists = [[rng.choice(pool) for _ in range(rng.randrange(1, 9))] for _ in range(80)]
    rows = [(str(i), j, v) for i, labels in enumerate(lists) for j, v in enumerate(labels)]
    got = header.disambiguate_labels(spark.createDataFrame(rows, "dataset_id string, col_idx int, header string")).collect()
    by = {}
    for r in got:
        by.setdefault(int(r.dataset_id), {})[r.col_idx] = r.header
    assert all([by[i][j] for j in range(len(labels))] == reference_labels(labels) for i, labels in enumerate(lists))


def test_dot_style_for_delimited_text(spark):
    rows = [("d", i, h) for i, h in enumerate(["Result", "Unit", "Result", "Unit"])]
    got = header.disambiguate_labels(spark.createDataFrame(rows, "dataset_id string, col_idx int, header string"), "dot")
    assert [r.header for r in got.orderBy("col_idx").collect()] == ["Result", "Unit", "Result.1", "Unit.1"]


def test_shapes(spark):
    book = {
        "plain": [["a", 1, "x"], ["b", 200, "y"], ["a", 3, "z"]],
        "gap": [["a", 1], [None, None], ["b", 2]],
        "leading_gap": [[None, None], ["a", 1], [None, None], ["b", 2]],
        "flip": [["name", "a", "b", "c"], ["dose", 1, 2, 3]],
        "matrix": [["c1", 1.0, 2.0, 3.0], ["c1", 2.0, 3.0, 4.0], ["c2", 1.5, 2.5, 3.5]],
    }
    got = {r.sheet: r["shape"] for r in shape.classify_shape(grid(spark, book)).collect()}
    assert got == {"plain": "row_per_record", "gap": "multiple_tables", "leading_gap": "row_per_record", "flip": "transposed", "matrix": "wide_matrix"}


def test_chained_ranges_against_brute_force(spark):
    rng = random.Random(11)
    sheets_, expected = {}, {}
    for s in range(40):
        spans = [(a := rng.randrange(60), a + rng.randrange(12)) for _ in range(6)]
        sheets_[f"s{s}"] = [[lo for lo, _ in spans], [hi for _, hi in spans]]
        group = list(range(6))
        for i in range(6):
            for j in range(6):
                if spans[i][0] <= spans[j][1] and spans[j][0] <= spans[i][1]:
                    old, new = group[j], group[i]
                    group = [new if g == old else g for g in group]
        expected[f"s{s}"] = max(group.count(g) for g in group)
    got = {r.sheet: r.cluster for r in shape.region_facts(grid(spark, sheets_), ["file_id", "sheet"]).collect() if r.cluster}
    assert got == expected


def test_range_join_against_brute_force(spark):
    rng = random.Random(5)
    points = [("k", i) for i in range(300)]
    ranges = [("k", n, lo := rng.randrange(300), lo + rng.choice([0, 1, 2, 3, 40, 200])) for n in range(30)]
    got = layout.range_join(
        spark.createDataFrame(points, "key string, p bigint"), spark.createDataFrame(ranges, "key string, n int, lo bigint, hi bigint"), ["key"], "p", "lo", "hi"
    ).select("p", "n").collect()
    assert sorted(map(tuple, got)) == sorted((p, n) for _, p in points for _, n, lo, hi in ranges if lo <= p <= hi)


def layouts(spark, rows):
    return spark.createDataFrame(rows, LAYOUT_SCHEMA)


def test_unpivot_combined_and_melted(spark):
    sheet = [["Name", "Ann", "Bob"], ["Dose", 1, 2], [None, None, None], ["Name", "x", "y"], [None, "stray", None]]
    g = grid(spark, {"kv": sheet})
    for melt, n_records in ((False, 1), (True, 2)):
        verdict = layouts(spark, [("book", "kv", "key_value", 1.0, "", None, None, None, [(0, [1, 2], 0, 4)], melt, [])])
        tables = layout.unpivot_key_value(g, verdict)
        headers = [r.header for r in tables.columns.orderBy("col_idx").collect()]
        rows = [r.cells for r in tables.rows.orderBy("row_idx").collect()]
        assert len(rows) == n_records
        if melt:
            assert headers == ["Name", "Dose", "Name (2)", ""]
            assert rows == [["Ann", "1", "x", "stray"], ["Bob", "2", "y", ""]]
        else:
            assert headers == ["Name", "Name (2)", "Dose", "Dose (2)", "Name (3)", "Name (4)", "", ""]
            assert rows == [["Ann", "Bob", "1", "2", "x", "y", "stray", ""]]


def test_blocks_outside_the_grid_read_nothing(spark):
    g = grid(spark, {"kv": [["a", 1]]})
    verdict = layouts(spark, [("book", "kv", "key_value", 1.0, "", None, None, None, [(0, [1], 0, 10**9)], False, [])])
    assert layout.unpivot_key_value(g, verdict).rows.count() == 0
    assert layout.unreadable_blocks(g, verdict).count() == 1


def test_fence_outside_the_grid_is_an_error(spark):
    g = grid(spark, {"s": [["h"], [1], [2]]})
    fenced = spark.createDataFrame([("book", "s", 0, 0, 1, 2, None), ("book", "s", 1, 0, 1, 9, None)], "file_id string, sheet string, table_idx int, header_row bigint, first_row bigint, last_row bigint, title_row bigint")
    tables, errors = layout.fence_tables(g, fenced)
    assert [r.cells for r in tables.rows.orderBy("row_idx").collect()] == [["1"], ["2"]]
    assert [r.table_idx for r in errors.collect()] == [1]


def test_sheet_descriptions_follow_verdicts(spark):
    g = grid(spark, {"s": BANNER, "odd": [["a", 1], [None, None], ["b", 2]]})
    plain = {r.sheet: (r.status, r.headers, r.row_count) for r in sheets.describe_sheets(g).collect()}
    assert plain["s"] == ("ok", ["Compound ID", "Result", "Units"], 3)
    verdict = layouts(spark, [("book", "s", "row_per_record", 1.0, "", 2, 3, 4, [], False, []), ("book", "odd", "not_a_table", 1.0, "", None, None, None, [], False, [])])
    judged = {r.sheet: (r.status, r.row_count) for r in sheets.describe_sheets(g, verdict).collect()}
    assert judged["s"] == ("ok", 2) and judged["odd"][0] == "unsupported_shape"


def test_blocked_prefix_sums(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randrange(3)) for k in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i bigint, n int")
    summed = running_sum(df, ["k"], "i", F.col("n"), "s", block_rows=7)
    got = {(r.k, r.i): r.s for r in summed.collect()}
    assert all(got[k, i] == sum(n for kk, ii, n in rows if kk == k and ii < i) for k, i, _ in rows)
    parity = running_parity(df, ["k"], "i", F.col("n") == 1, "p", block_rows=7)
    assert all(r.p == (sum(n == 1 for kk, ii, n in rows if kk == r.k and ii < r.i) % 2 == 1) for r in parity.collect())
