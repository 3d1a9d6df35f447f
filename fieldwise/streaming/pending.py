"""Reviews that wait for confirmation, and their expiry."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..model import PENDING_TTL_HOURS


def expire_pending(pending: DataFrame, confirmations: DataFrame, now: Column, ttl_hours: int = PENDING_TTL_HOURS) -> DataFrame:
    """T2 in batch: token, created_at, confirmed_at, state.

    pending: token (unique), created_at; confirmations: token, confirmed_at. A confirmation counts until
    the entry is 24 hours old; a later one is `late`. Unconfirmed entries are `live`, then `expired`.
    """
    arrived = confirmations.filter(F.col("confirmed_at") <= now)
    first = (
        pending.select("token", "created_at").join(arrived, "token")
        .filter(F.col("confirmed_at") >= F.col("created_at"))
        .groupBy("token").agg(F.min("confirmed_at").alias("confirmed_at"))
    )
    deadline = F.col("created_at") + F.make_interval(hours=F.lit(ttl_hours))
    state = (
        F.when(F.col("confirmed_at") < deadline, "confirmed")
        .when(F.col("confirmed_at").isNotNull(), "late")
        .when(deadline > now, "live")
        .otherwise("expired")
    )
    return pending.join(first, "token", "left").select("token", "created_at", "confirmed_at", state.alias("state"))


OPENED, CONFIRMED = "opened", "confirmed"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRANSITION = "token string, at timestamp, state string, created_at timestamp, confirmed_at timestamp"
REJECTED = ("late", "unknown")


BUCKETS = 2_048  # keys of the state: a call to the state store costs as much as thousands of events, so tokens share them


class Review(StatefulProcessor):
    """The reviews of one bucket of tokens: each live from its opening, confirmed or expired after that, and late for a confirmation that comes later still.

    Events wait in the state until the watermark passes them, and are taken in event time, so the answer does not depend on the order of
    arrival. One timer is armed for the next event, deadline, or moment at which a closed review may be forgotten; nothing is kept beyond that.
    """

    def __init__(self, ttl_hours: int, remember_hours: int):
        self.ttl, self.remember = ttl_hours * 3_600_000, remember_hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "token string, at timestamp, kind string")
        self.reviews = handle.getListState("reviews", "token string, created_at timestamp, deadline bigint, state string")
        self.armed = handle.getValueState("armed", "moment bigint")

    def handleInputRows(self, key, rows, timerValues):
        yield from self._advance([(r.token, r.at, r.kind) for r in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._advance([], timerValues)

    def _advance(self, arrived, timers):
        """Takes all events and deadlines up to the watermark, in order."""
        now = timers.getCurrentWatermarkInMs()
        waited = [tuple(w) for w in self.waiting.get()]
        held = [*waited, *arrived]
        past, later = [e for e in held if _millis(e[1]) <= now], [e for e in held if _millis(e[1]) > now]
        kept = {token: tuple(review) for token, *review in self.reviews.get()}
        reviews = dict(kept)
        for token, at, kind in sorted(past, key=_order):
            created, deadline, state = reviews.get(token, (None, None, None))
            if state == "live" and _millis(at) >= deadline:
                state = "expired"
                yield self._expired(token, created)
            if kind == OPENED and state is None:
                created, deadline, state = at, _millis(at) + self.ttl, "live"
                yield Row(token=token, at=at, state=state, created_at=at, confirmed_at=None)
            elif kind == CONFIRMED and state == "live":
                state = "confirmed"
                yield Row(token=token, at=at, state=state, created_at=created, confirmed_at=at)
            elif kind == CONFIRMED and state in (None, "expired"):
                said = "unknown" if state is None else "late"
                state = None if state is None else "late"
                yield Row(token=token, at=at, state=said, created_at=created, confirmed_at=at)
            if state is not None:
                reviews[token] = (created, deadline, state)
        awaited = {token for token, *_ in later}
        for token, (created, deadline, state) in list(reviews.items()):
            if state == "live" and now >= deadline:
                reviews[token] = (created, deadline, "expired")
                yield self._expired(token, created)
            if now >= deadline + self.remember and token not in awaited:
                del reviews[token]
        if past:
            _put(self.waiting, later)
        elif arrived:
            self.waiting.appendList(arrived)
        if reviews != kept:
            _put(self.reviews, [(token, *review) for token, review in reviews.items()])
        self._arm(later, reviews, now)

    def _expired(self, token, created):
        return Row(token=token, at=created + timedelta(milliseconds=self.ttl), state="expired", created_at=created, confirmed_at=None)

    def _arm(self, later, reviews, now):
        """A timer at the next moment at which the watermark can change anything."""
        moments = [_millis(at) for _, at, _ in later]
        moments += [deadline if state == "live" else max(deadline + self.remember, now + 1) for _, deadline, state in reviews.values()]
        if not moments:
            return
        armed = self.armed.get()[0] if self.armed.exists() else None
        if armed is None or armed <= now or min(moments) < armed:
            self.handle.registerTimer(min(moments))
            self.armed.update((min(moments),))


def _put(state, rows: list[tuple]) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


def _millis(at: datetime) -> int:
    return int(at.replace(tzinfo=at.tzinfo or timezone.utc).timestamp() * 1000)


def _order(event: tuple[str, datetime, str]) -> tuple[datetime, bool]:
    return event[1], event[2] == CONFIRMED  # a review is opened before it is confirmed


def watch_pending(
    pending: DataFrame, confirmations: DataFrame, ttl_hours: int = PENDING_TTL_HOURS, lateness: str = "10 minutes", remember_hours: int = 30 * 24, buckets: int = BUCKETS
) -> DataFrame:
    """T2 on streams: every change of a review's state (token, at, state, created_at, confirmed_at).

    States are live, confirmed and expired; `late` and `unknown` are confirmations of an expired review, and of one that never was or is
    forgotten (`remember_hours` after its deadline). A review of which no event can matter any more costs no state. State is keyed by
    one of `buckets` hashes of the token; the number stays with a checkpoint. The state store has to be one
    with timers: start the query inside `timed_state`.
    """
    opened = pending.select("token", F.col("created_at").alias("at"), F.lit(OPENED).alias("kind"))
    closed = confirmations.select("token", F.col("confirmed_at").alias("at"), F.lit(CONFIRMED).alias("kind"))
    events = opened.unionByName(closed).withWatermark("at", lateness)
    return events.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets))).groupBy("bucket").transformWithState(
        statefulProcessor=Review(ttl_hours, remember_hours), outputStructType=TRANSITION, outputMode="Append", timeMode="EventTime"
    )


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in a store that has timers; the session's own setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def start_pending(transitions: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes the changes to `<out>/states` and confirmations that came too late to `<out>/rejects`; a retried batch replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # a batch of changes, read twice
        rejected = F.col("state").isin(*REJECTED)
        batch.filter(F.col("state") != "unknown").write.mode("overwrite").parquet(f"{out}/states/batch={batch_id}")
        batch.filter(rejected).select("token", "confirmed_at", F.col("state").alias("reason")).write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}")
        batch.unpersist()

    with timed_state(transitions.sparkSession):
        writer = transitions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_states(spark: SparkSession, out: str) -> DataFrame:
    """token, created_at, confirmed_at, state of every review as of its last change."""
    changes = spark.read.parquet(f"{out}/states")
    last = F.max(F.struct("at", F.coalesce("confirmed_at", "created_at"), "state", "created_at", "confirmed_at")).alias("_l")
    return changes.groupBy("token").agg(last).select("token", "_l.created_at", "_l.confirmed_at", "_l.state")
