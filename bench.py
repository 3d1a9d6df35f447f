"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyarrow.parquet as pq  # noqa: E402

from fieldwise.session import local_session, workspace  # noqa: E402
from fieldwise.workload import QUERIES  # noqa: E402
from fieldwise.workload.registry import READ  # noqa: E402

HEADLINE = [
    "locale_classify", "locale_wide", "number_convert", "date_order", "date_order_wide", "date_resolve", "validate_notes", "assemble_records", "assemble_wide",
    "header_scores", "shape_classify", "sheet_rank", "fence_tables", "unpivot_labels", "comment_strip", "delimiter_detect",
    "column_signature", "schema_scores", "near_matches", "delimited_scan", "alias_first_write", "profile_last_write", "reconcile_conflicts",
    "redact_types", "pending_expiry", "workbook_report", "readiness_report",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
ONCE_S = 12  # a query that takes longer warm is timed once


def rows_read() -> int:
    """Rows of the given tables that the query has asked for, each table once, also where its plan goes on from settled ones."""
    return sum(pq.ParquetFile(f).metadata.num_rows for f in READ)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    spark = local_session(cpus, "fieldwise-bench")
    only = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    seconds: dict[str, float] = {}
    rates: dict[str, int] = {}
    for name in only:
        times = []
        READ.clear()
        for _ in range(1 + RUNS):  # the first run warms the JVM and the generated code
            start = time.perf_counter()
            with workspace(spark):
                df = QUERIES[name](spark, sf_dir)
                df.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            if len(times) > 1 and times[-1] > ONCE_S:
                break
        seconds[name] = round(statistics.median(times[1:]), 3)
        rates[name] = round(rows_read() / seconds[name])
        print(f"{name}: first {times[0]:.2f}s, warm {seconds[name]:.2f}s", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total seconds over headline queries, warm median", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows_per_sec": rates, "sf": float(scale.group(1)) if scale else None, "cpus": cpus, "runs": RUNS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
