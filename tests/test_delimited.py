"""The delimited source on small files written here."""

from __future__ import annotations

import csv
import io
import random

import pytest

from fieldwise.sources import delimited

FILES = {
    "plain.csv": "a,b,c\n1,2,3\n4,5,6\n",
    "comments.csv": "# made by ; lab ; one\n# second\nCompound;Value\nx;1,5\ny;2,5\n",
    "hash_header.csv": 'Name,# Reps,Lot\n"A",3,Lot #42\n',
    "quoted.csv": 'k,text\n1,"line one\n# not a comment\nline three"\n2,"say ""hi"", ok"\n3,5" pipe\n',
    "mixed_ends.csv": "a,b\r\n1,2\r3,4\n",
    "bom.csv": "﻿a;b\n1;2\n",
    "short_row.csv": "a,b,c\n1,2,3\n4\n",
    "dup.csv": "Result,Unit,Result\n1,g,2\n",
    "na.csv": "a,b\nN/A,1\nx,null\n",
    "header_only.csv": "a,b\n",
    "blank_gap.csv": "a,b\n1,2\n\nc,d\n3,4\n",
    "wide_row.csv": "a,b\n1,2\n1,2,3\n4,5\n",
    "shifted.csv": "a,b\n1,2,3\n4,5,6\n",
    "empty.csv": "",
    "only_comments.csv": "# nothing\n# here\n",
    "guarded.csv": "# a,b\n1,2\n3,4\n",
    "open_quote.csv": 'a,b\n1,"never closed\n2,3\n',
    "notes.txt": "a,b\n",
    "old.xls": "x",
}


@pytest.fixture(scope="module")
def scan(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    for name, text in FILES.items():
        (folder / name).write_bytes(text.encode())
    (folder / "latin.csv").write_bytes("näme,b\n1,2\n".encode("latin-1"))
    found = delimited.scan_delimited(spark, str(folder))
    sheet = {r.dataset_id: r.sheet for r in found.tables.datasets.collect()}
    headers, rows = {}, {}
    for r in found.tables.columns.collect():
        headers.setdefault(sheet[r.dataset_id], {})[r.col_idx] = r.header
    for r in found.tables.rows.orderBy("row_idx").collect():
        rows.setdefault(sheet[r.dataset_id], []).append(r.cells)
    errors = {r.file_id.rsplit("/", 1)[1]: r.error for r in found.errors.collect()}
    questions = {sheet[r.dataset_id] for r in found.questions.collect()}
    return {k: [v[i] for i in sorted(v)] for k, v in headers.items()}, rows, errors, questions


def test_tables_read(scan):
    headers, rows, _, _ = scan
    assert headers["comments.csv"] == ["Compound", "Value"] and rows["comments.csv"] == [["x", "1,5"], ["y", "2,5"]]
    assert headers["hash_header.csv"] == ["Name", "# Reps", "Lot"] and rows["hash_header.csv"] == [["A", "3", "Lot #42"]]
    assert rows["quoted.csv"] == [["1", "line one\n# not a comment\nline three"], ["2", 'say "hi", ok'], ["3", '5" pipe']]
    assert rows["mixed_ends.csv"] == [["1", "2"], ["3", "4"]]
    assert headers["bom.csv"] == ["a", "b"]
    assert rows["short_row.csv"] == [["1", "2", "3"], ["4", "", ""]]
    assert headers["dup.csv"] == ["Result", "Unit", "Result.1"]
    assert rows["na.csv"] == [["", "1"], ["x", ""]]
    assert headers["header_only.csv"] == ["a", "b"] and "header_only.csv" not in rows
    assert rows["blank_gap.csv"] == [["1", "2"], ["c", "d"], ["3", "4"]]


def test_errors_are_named_and_complete(scan):
    headers, _, errors, questions = scan
    assert set(errors) == {
        "wide_row.csv", "shifted.csv", "empty.csv", "only_comments.csv", "guarded.csv", "open_quote.csv", "notes.txt", "old.xls", "latin.csv",
    }
    assert all(e.startswith(f"Cannot ingest {n}:") for n, e in errors.items())
    assert not set(errors) & set(headers)
    assert questions == {"blank_gap.csv"}


def test_records_against_csv_reader(spark):
    """Random quoting over several lines and tiny blocks, against the standard reader."""
    rng = random.Random(2)
    files, expected = [], {}
    for n in range(40):
        table = [["".join(rng.choice('ab,"\n;') for _ in range(rng.randrange(5))) for _ in range(3)] for _ in range(rng.randrange(2, 8))]
        table = [[c or "x" for c in row] for row in table]
        buffer = io.StringIO()
        csv.writer(buffer, lineterminator="\n").writerows(table)
        files.append((str(n), buffer.getvalue()))
        expected[str(n)] = list(csv.reader(io.StringIO(buffer.getvalue())))
    lines = [(f, i, line, ",") for f, text in files for i, line in enumerate(text[:-1].split("\n"))]
    df = spark.createDataFrame(lines, "file_id string, line_no bigint, text string, delimiter string")
    placed = delimited.place_records(df, block_rows=3)
    got: dict[str, list] = {}
    records = delimited.join_records(placed).select("file_id", "record_no", delimited.split_fields(placed["text"], placed["delimiter"]).alias("f"))
    for r in records.orderBy("record_no").collect():
        got.setdefault(r.file_id, []).append(r.f)
    assert got == expected


def test_delimiter_answer_wins(spark):
    lines = spark.createDataFrame([("f", 0, "a;b,c"), ("f", 1, "1;2,3"), ("g", 0, "word"), ("g", 1, "other")], "file_id string, line_no bigint, text string")
    hints = spark.createDataFrame([("f", "|")], "file_id string, delimiter string")
    plain = {r.file_id: r.delimiter for r in delimited.detect_delimiter(lines).collect()}
    assert plain == {"f": ",", "g": ","}
    assert {r.file_id: r.delimiter for r in delimited.detect_delimiter(lines, hints).collect()}["f"] == "|"
