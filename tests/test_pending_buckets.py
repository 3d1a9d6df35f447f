"""Reviews that share a state: many tokens in few buckets, over several batches, agree with the batch form."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from fieldwise.streaming.pending import current_states, expire_pending, start_pending, watch_pending


def test_tokens_that_share_a_bucket_keep_their_own_reviews(spark, tmp_path):
    rng, day = random.Random(7), dt.datetime(2024, 1, 1)
    events = [(f"t{rng.randrange(60)}", day + dt.timedelta(minutes=rng.randrange(4 * 24 * 60)), rng.choice(["opened", "confirmed"])) for _ in range(240)]
    events.sort(key=lambda e: e[1])
    clock = ("clock", day + dt.timedelta(days=5), "opened")
    for k, part in enumerate((events[:80], events[80:160], [*events[160:], clock])):
        spark.createDataFrame(part, "token string, at timestamp, kind string").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    source = spark.readStream.schema("token string, at timestamp, kind string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    opened = source.filter("kind = 'opened'").select("token", F.col("at").alias("created_at"))
    closed = source.filter("kind = 'confirmed'").select("token", F.col("at").alias("confirmed_at"))
    query = start_pending(watch_pending(opened, closed, lateness="5 days", buckets=3), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    # the watermark ends five days before the clock's event: nothing but the events of the first moment can have passed
    assert spark.read.parquet(str(tmp_path / "out" / "states")).count() == sum(e[1] <= day and e[2] == "opened" for e in events)

    query = start_pending(watch_pending(opened, closed, lateness="1 minute", buckets=3), str(tmp_path / "out2"), str(tmp_path / "state2"))
    query.awaitTermination()
    got = {r.token: (r.created_at, r.confirmed_at, r.state) for r in current_states(spark, str(tmp_path / "out2")).collect()}
    frame = spark.createDataFrame(events, "token string, at timestamp, kind string")
    pending = frame.filter("kind = 'opened'").groupBy("token").agg(F.min("at").alias("created_at"))
    confirmations = frame.filter("kind = 'confirmed'").select("token", F.col("at").alias("confirmed_at"))
    expected = expire_pending(pending, confirmations, F.lit(day + dt.timedelta(days=5) - dt.timedelta(minutes=1)))
    assert got == {r.token: (r.created_at, r.confirmed_at, r.state) for r in expected.collect()}
