"""Arriving files: one pass, replay, and a later file."""

from __future__ import annotations

from pathlib import Path

from fieldwise.model import Field, FieldSet
from fieldwise.streaming.ingest import ingested, stream_ingest

FIELDS = FieldSet("f", (Field("id", "integer"), Field("value", "number"), Field("kind", "text", allowed_values=("a", "b"))))


def test_replay_changes_nothing_and_unready_files_wait(spark, tmp_path):
    landing, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    landing.mkdir()
    (landing / "good.csv").write_text("id,value,kind\n1,2.5,a\n2,3.5,b\n")
    (landing / "bad.csv").write_text("id,value,kind\n1,2.5,z\n")

    def run(state=state, **options):
        stream_ingest(spark, str(landing), FIELDS, out, state, **options).awaitTermination()
        tidy, review = ingested(spark, out, "tidy"), ingested(spark, out, "review")
        return sorted((r.id, r.value) for r in tidy.collect()), {r.source_file.rsplit("/", 1)[1] for r in review.collect()}

    first = run()
    assert first == ([(1, 2.5), (2, 3.5)], {"bad.csv"})
    assert run() == first
    (landing / "later.csv").write_text("Kind,VALUE,id\na,9.5,7\n")
    assert run() == ([(1, 2.5), (2, 3.5), (7, 9.5)], {"bad.csv"})
    # the same files under other batches, by a stream that starts anew
    assert run(state=str(tmp_path / "again")) == ([(1, 2.5), (2, 3.5), (7, 9.5)], {"bad.csv"})
    # a mended file moves from one sink to the other, and leaves nothing behind
    (landing / "bad.csv").write_text("id,value,kind\n1,2.5,a\n")
    assert run(state=str(tmp_path / "third")) == ([(1, 2.5), (1, 2.5), (2, 3.5), (7, 9.5)], set())
    # what a batch settles goes with it
    left = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not list(Path(left).glob("fieldwise/run-*"))
