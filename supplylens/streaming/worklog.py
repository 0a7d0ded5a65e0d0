"""Folds over the work log, as batch jobs and as stateful streams with the same rules.

The batch forms sort and fold each key's events in the JVM; the streams hold a state tuple, which plain functions move on. Both give the same final
rows for events that come in order; a stream folds an event that comes late where it comes, and one behind the watermark not at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from supplylens.functions import backoff_seconds, fnv_bucket, is_valid_transition, truncate_period
from supplylens.functions.work import TRANSITIONS

TERMINAL = ("succeeded", "failed", "dead_letter")
ALLOWED = frozenset((a, b) for a, to in TRANSITIONS.items() for b in to)

REQUEST_STATE = "status string, priority int, attempts int, not_before timestamp, requests long"
REQUEST_OUT = "queue string, key string, " + REQUEST_STATE
LIFECYCLE_STATE = "status string, accepted long, rejected long"
LIFECYCLE_OUT = "queue string, key string, " + LIFECYCLE_STATE


def request_step(state: tuple | None, kind: str, priority: int, not_before) -> tuple:
    """One event of an item. A ``request`` joins a pending item (largest priority, newest time), revives a finished one and is ignored in flight; other kinds set the status."""
    if state is None:
        return ("pending", priority, 0, not_before, 1) if kind == "request" else (kind, priority, 1 if kind == "claimed" else 0, not_before, 0)
    status, old_priority, attempts, old_time, n = state
    if kind == "request":
        if status == "pending":
            return status, max(old_priority, priority), attempts, not_before, n + 1
        if status in TERMINAL:
            return "pending", priority, 0, not_before, n + 1
        return state
    return kind, old_priority, attempts + (kind == "claimed"), old_time, n


def lifecycle_step(state: tuple | None, to: str) -> tuple:
    """One transition: legal ones move the item, others are counted. The first event of an item must be ``pending``."""
    status, ok, bad = state or (None, 0, 0)
    if (status is None and to == "pending") or (status, to) in ALLOWED:
        return to, ok + 1, bad
    return status, ok, bad + 1


def _none(x) -> Any:
    return None if x is None or x is pd.NaT or x != x else x


def _fold_requests(state, frame: pd.DataFrame):
    for kind, priority, at in zip(frame["kind"], frame["priority"], frame["not_before"]):
        state = request_step(state, kind, int(priority), _none(at))
    return state


def _fold_lifecycle(state, frame: pd.DataFrame):
    for to in frame["to_status"]:
        state = lifecycle_step(state, to)
    return state


def fold_requests(events: DataFrame) -> DataFrame:
    """State of each (queue, key) after all its events (event_id, ts, queue, key, kind, priority, not_before), in order of ts, then id.

    Batch form, in the JVM: the events of a key are sorted and folded by ``aggregate``.
    """
    e = F.sort_array(F.collect_list(F.struct("ts", "event_id", "kind", "priority", "not_before")))
    start = F.lit(None).cast("struct<status:string,priority:int,attempts:int,not_before:timestamp,requests:bigint>")
    made = lambda status, priority, attempts, at, n: F.struct(
        status.alias("status"), priority.cast("int").alias("priority"), attempts.cast("int").alias("attempts"), at.alias("not_before"), n.cast("bigint").alias("requests")
    )

    def step(s, x):
        asked = x["kind"] == "request"
        first = F.when(asked, made(F.lit("pending"), x["priority"], F.lit(0), x["not_before"], F.lit(1))).otherwise(
            made(x["kind"], x["priority"], F.when(x["kind"] == "claimed", 1).otherwise(0), x["not_before"], F.lit(0))
        )
        waiting = made(s["status"], F.greatest(s["priority"], x["priority"]), s["attempts"], x["not_before"], s["requests"] + 1)
        again = made(F.lit("pending"), x["priority"], F.lit(0), x["not_before"], s["requests"] + 1)
        moved = made(x["kind"], s["priority"], s["attempts"] + F.when(x["kind"] == "claimed", 1).otherwise(0), s["not_before"], s["requests"])
        return (
            F.when(s.isNull(), first).when(asked & (s["status"] == "pending"), waiting).when(asked & s["status"].isin(*TERMINAL), again).when(asked, s).otherwise(moved)
        )

    return events.groupBy("queue", "key").agg(F.aggregate(e, start, step).alias("s")).select("queue", "key", "s.*")


def replay_lifecycle(events: DataFrame) -> DataFrame:
    """Current status and numbers of accepted and rejected transitions of each (queue, key) from (event_id, ts, queue, key, to_status), in the JVM."""
    e = F.sort_array(F.collect_list(F.struct("ts", "event_id", "to_status")))
    start = F.lit(None).cast("struct<status:string,accepted:bigint,rejected:bigint>")
    made = lambda status, ok, bad: F.struct(status.cast("string").alias("status"), ok.cast("bigint").alias("accepted"), bad.cast("bigint").alias("rejected"))

    def step(s, x):
        status, accepted, rejected = s["status"], F.coalesce(s["accepted"], F.lit(0)), F.coalesce(s["rejected"], F.lit(0))
        legal = F.when(status.isNull(), x["to_status"] == "pending").otherwise(is_valid_transition(status, x["to_status"]))
        return F.when(F.coalesce(legal, F.lit(False)), made(x["to_status"], accepted + 1, rejected)).otherwise(made(status, accepted, rejected + 1))

    return events.groupBy("queue", "key").agg(F.aggregate(e, start, step).alias("s")).select("queue", "key", "s.*")


def _stream(events: DataFrame, fold, state_schema: str, out: str, watermark: str) -> DataFrame:
    names = [c.split()[0] for c in out.split(", ")]

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        held = fold(held, pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable"))
        state.update(held)
        yield pd.DataFrame([(*key, *held)], columns=names)

    marked = events.withWatermark("ts", watermark)
    return marked.groupBy("queue", "key").applyInPandasWithState(update, out, state_schema, "update", GroupStateTimeout.NoTimeout)


def fold_requests_stream(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Streaming form of :func:`fold_requests`; each batch yields the new state of the keys it touched."""
    return _stream(events, _fold_requests, REQUEST_STATE, REQUEST_OUT, watermark)


def replay_lifecycle_stream(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    return _stream(events, _fold_lifecycle, LIFECYCLE_STATE, LIFECYCLE_OUT, watermark)


def lease_expiry(events: DataFrame, lease_seconds: int, now) -> DataFrame:
    """Items in flight whose last claim or heartbeat is more than the lease before ``now``: (queue, key, worker_id, expired_at)."""
    last = events.groupBy("queue", "key").agg(F.max_by(F.struct("kind", "ts", "worker_id"), F.struct("ts", "event_id")).alias("l"))
    at = F.col("l.ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease_seconds))
    return last.filter(F.col("l.kind").isin("claimed", "running", "heartbeat") & (at < F.lit(now))).select("queue", "key", F.col("l.worker_id").alias("worker_id"), at.alias("expired_at"))


def lease_expiry_stream(events: DataFrame, lease_seconds: int, watermark: str = "1 minute") -> DataFrame:
    """Streaming form with event-time timers: a row when the watermark passes an item's lease."""

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            worker, at = state.get
            state.remove()
            yield pd.DataFrame({"queue": [key[0]], "key": [key[1]], "worker_id": [worker], "expired_at": [at]})
            return
        frame = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable").iloc[-1]
        if frame["kind"] in ("claimed", "running", "heartbeat"):
            at = frame["ts"].to_pydatetime() + pd.Timedelta(seconds=lease_seconds).to_pytimedelta()
            state.update((frame["worker_id"], at))
            state.setTimeoutTimestamp(max(int(pd.Timestamp(at).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    marked = events.withWatermark("ts", watermark)
    return marked.groupBy("queue", "key").applyInPandasWithState(
        update, "queue string, key string, worker_id string, expired_at timestamp", "worker_id string, expires timestamp", "append", GroupStateTimeout.EventTimeTimeout
    )


def outcome_disposition(responses: DataFrame, max_attempts: int = 5, base: float = 10, most: float = 3600) -> tuple[DataFrame, DataFrame]:
    """(outcomes, children) of worker responses (queue, key, action, error, attempts, requeue_after, fan_out_keys, priority).

    A rejection is dead at once. An error, and an action that isn't known, wait for another try or are dead at the last attempt. Requeueing and infrastructure
    failures use no attempt up. Fanning out succeeds and makes pending children of the same priority.
    """
    failed = (F.coalesce("error", F.lit("")) != "") & ~F.col("action").isin("infra_failure")
    known = F.col("action").isin("completed", "converged", "requeue", "fan_out", "reject", "infra_failure")
    again = failed | ~known
    last = F.col("attempts") >= max_attempts
    a = F.col("action")
    status = (
        F.when(a == "reject", "dead_letter").when(a == "infra_failure", "pending").when(again & last, "dead_letter").when(again, "pending").when(a == "requeue", "pending").otherwise("succeeded")
    )
    delay = (
        F.when(a == "infra_failure", F.lit(30.0)).when((a != "reject") & again & ~last, backoff_seconds("attempts", base, most)).when((a == "requeue") & ~again, F.coalesce(F.col("requeue_after").cast("double"), F.lit(30.0)))
    )
    keeps = (a == "infra_failure") | ((a == "requeue") & ~again)
    out = responses.select("queue", "key", status.alias("status"), delay.alias("delay_s"), F.when(keeps, F.greatest(F.lit(0), F.col("attempts") - 1)).otherwise(F.col("attempts")).alias("attempts"))
    children = responses.filter((a == "fan_out") & ~failed).select("queue", F.explode("fan_out_keys").alias("key"), "priority", F.lit("pending").alias("status"))
    return out, children


def alert_rules(events: DataFrame, window: str = "5 minutes", watermark: str | None = None, exact: bool = False, limits: dict | None = None) -> DataFrame:
    """(queue, window_start, rates and alerts) of transitions (queue, ts, to_status, duration, attempts) by window.

    Alerts: any dead letter, p99 of the reconcile time over 300 s, median attempts over 3, more than 1000 items that became pending. Where the
    transitions say whether a lease was reaped (``reaped``) or how long a claim took (``claim_s``): any reaped lease, p99 of the claims over 0.1 s.
    """
    limits = {"p99_s": 300, "attempts": 3, "pending": 1000, "claim_p99_s": 0.1} | (limits or {})
    rows = events.withWatermark("ts", watermark) if watermark else events
    q = F.percentile if exact else F.approx_percentile
    grouped = rows.groupBy("queue", F.window("ts", window).alias("w")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("to_status") == "dead_letter").alias("dead_letters"),
        F.count_if(F.col("to_status") == "pending").alias("pending"),
        q("duration", F.lit(0.99)).alias("p99_s"),
        q("attempts", F.lit(0.5)).alias("median_attempts"),
        *([F.count_if("reaped").alias("reaped")] if "reaped" in events.columns else []),
        *([q("claim_s", F.lit(0.99)).alias("claim_p99_s")] if "claim_s" in events.columns else []),
    )
    more = [F.col("reaped"), (F.col("reaped") > 0).alias("alert_reaped")] if "reaped" in events.columns else []
    more += [F.col("claim_p99_s"), F.coalesce(F.col("claim_p99_s") > limits["claim_p99_s"], F.lit(False)).alias("alert_claims")] if "claim_s" in events.columns else []
    return grouped.select(
        "queue", F.col("w.start").alias("window_start"), "n", "dead_letters", "pending", "p99_s", "median_attempts",
        (F.col("dead_letters") > 0).alias("alert_dead_letter"), F.coalesce(F.col("p99_s") > limits["p99_s"], F.lit(False)).alias("alert_slow"),
        F.coalesce(F.col("median_attempts") > limits["attempts"], F.lit(False)).alias("alert_attempts"), (F.col("pending") > limits["pending"]).alias("alert_backlog"), *more,
    )


def event_feed(events: DataFrame, queue: str) -> DataFrame:
    """Status events of one queue; works on streams as on tables."""
    return events.filter(F.col("queue") == queue).select("key", "to_status", "ts")


def probe_windows(log: DataFrame, window: str = "5 minutes", watermark: str | None = None) -> DataFrame:
    """Availability of each image by window."""
    rows = log.withWatermark("ts", watermark) if watermark else log
    grouped = rows.groupBy("image", F.window("ts", window).alias("w")).agg(F.count("*").alias("probes"), F.count_if(F.col("success")).alias("ok"), F.avg("duration").alias("mean_duration"))
    return grouped.select("image", F.col("w.start").alias("window_start"), "probes", "ok", (F.col("ok") / F.col("probes")).alias("availability"), "mean_duration")


def eligible(items: DataFrame, now) -> DataFrame:
    return items.filter(F.col("not_before").isNull() | (F.col("not_before") <= F.lit(now)))


def resync_shard(keys: DataFrame, queue: str, now, period: int, tick: int, priority=None) -> DataFrame:
    """(key, second, not_before, priority): the keys whose second of the period falls into the current tick.

    ``now`` in Unix seconds; ``period`` is a multiple of ``tick``. Over the ticks of a period every key comes exactly once, at another second in each period
    and queue.
    """
    if period <= 0 or period % tick:
        raise ValueError("the period must be a positive multiple of the tick")
    start = truncate_period(F.timestamp_seconds(F.lit(now)), period)
    tick_start = truncate_period(F.timestamp_seconds(F.lit(now)), tick)
    # Queue, a zero byte and the period's start as eight big-endian bytes.
    salt = F.concat(F.encode(F.lit(queue), "UTF-8"), F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(start), 16, "0")))
    rows = keys.withColumn("second", fnv_bucket(salt, "key", period))
    first = tick_start - start
    rows = rows.filter((F.col("second") >= first) & (F.col("second") < first + tick))
    return rows.select("key", "second", F.timestamp_seconds(tick_start + F.col("second") - first).alias("not_before"), (F.lit(0) if priority is None else priority).alias("priority"))
