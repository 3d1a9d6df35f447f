"""Map files as they arrive, into sinks that are keyed by dataset."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import FieldSet, Tables, dataset_id
from ..operators.convert import assemble, bind
from ..plans.pipeline import Review, map_corpus
from ..session import settle, workspace
from ..sources.delimited import placed_lines, scan_lines

# Files one micro-batch takes in.
MAX_FILES = 500
SINKS = ("tidy", "review", "errors", "questions", "date_questions")


def arriving_lines(spark: SparkSession, landing: str, max_files: int = MAX_FILES) -> DataFrame:
    """A stream of the lines of new files, each with its file and split; names and contents stay in the tasks."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.csv").load(landing).select("value", "_metadata")


def write_keyed(frame: DataFrame, folder: str) -> None:
    """Replace the partitions of the datasets that `frame` has; others stay."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(folder)


def ingest_batch(
    lines: DataFrame,
    field_set: FieldSet,
    out: str,
    aliases: Callable[[], DataFrame | None] = lambda: None,
    profiles: Callable[[], DataFrame | None] = lambda: None,
    after: Callable[[Tables, Review], None] | None = None,
) -> None:
    """One micro-batch through the same ladder as a batch run.

    Ready datasets go straight to `tidy`; others leave their mappings in `review` and their questions. Every sink is keyed by dataset, and
    `status` is written last and names the run whose rows count: a retried batch, or a file that comes again under another batch, replaces what it left
    before and changes nothing else. What the batch settled on the way goes when it ends; `after` is called before that, to learn from what is ready, say.
    """
    spark = lines.sparkSession
    run = F.lit(uuid.uuid4().hex)
    with workspace(spark):
        scan = scan_lines(placed_lines(lines))
        review = map_corpus(scan.tables, field_set, aliases(), profiles())
        ready = review.readiness.filter("ready").select("dataset_id")
        bound = settle(bind(review.mappings.join(ready, "dataset_id", "left_semi"), review.columns, field_set.frame(spark), review.formats))
        named = scan.tables.datasets.select("dataset_id", "source_file")
        tidy = assemble(scan.tables.rows, bound, field_set, scan.tables.datasets)
        errors = scan.errors.select(dataset_id(F.col("file_id"), F.lit(None).cast("string"), F.lit(0)).alias("dataset_id"), "file_id", "error")
        outputs = {
            "tidy": tidy.join(named, "dataset_id"),
            "review": review.mappings.join(ready, "dataset_id", "left_anti").join(named, "dataset_id"),
            "errors": errors,
            "questions": scan.questions.join(named, "dataset_id"),
            "date_questions": review.date_questions.join(named, "dataset_id"),
        }
        for name, frame in outputs.items():
            write_keyed(frame.withColumn("run", run), f"{out}/{name}")
        state = F.when(F.coalesce("ready", F.lit(False)), "tidy").otherwise("review")
        status = named.join(review.readiness, "dataset_id", "left").select("dataset_id", "source_file", state.alias("state"))
        failed = errors.join(named, "dataset_id", "left_anti").select("dataset_id", F.col("file_id").alias("source_file"), F.lit("error").alias("state")).distinct()
        write_keyed(status.unionByName(failed).withColumn("run", run), f"{out}/status")
        if after is not None:
            after(scan.tables, review)


def ingested(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A sink's rows as of each dataset's last complete run, without what an earlier run left behind."""
    if name not in SINKS:
        raise ValueError(f"no sink named {name!r}; there are {', '.join(SINKS)}")
    status = spark.read.parquet(f"{out}/status").select("dataset_id", "run")
    return spark.read.parquet(f"{out}/{name}").join(status, ["dataset_id", "run"], "left_semi").drop("run")


def stream_ingest(
    spark: SparkSession,
    landing: str,
    field_set: FieldSet,
    out: str,
    checkpoint: str,
    aliases: Callable[[], DataFrame | None] = lambda: None,
    profiles: Callable[[], DataFrame | None] = lambda: None,
    available_now: bool = True,
    max_files: int = MAX_FILES,
    after: Callable[[Tables, Review], None] | None = None,
) -> StreamingQuery:
    """Start the stream. Dictionaries are read anew for every batch, so edits take effect at once."""

    def run(lines: DataFrame, batch_id: int) -> None:
        ingest_batch(lines, field_set, out, aliases, profiles, after)

    writer = arriving_lines(spark, landing, max_files).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
