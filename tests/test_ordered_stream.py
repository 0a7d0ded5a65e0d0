"""Streams with buffers and timers against the batch folds."""

import datetime as dt
import random

import pytest

from supplylens.streaming import ordered, worklog

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, queue string, key string, kind string, to_status string, priority int, not_before timestamp"
KINDS, STATES = ["request", "request", "claimed", "succeeded", "failed"], ["pending", "claimed", "running", "succeeded", "failed"]


def log(seed, n):
    rng = random.Random(seed)
    return [(i, T0 + dt.timedelta(seconds=20 * (i // 2)), "q", f"k{rng.randrange(7)}", rng.choice(KINDS), rng.choice(STATES), rng.randrange(5), rng.choice([None, T0 + dt.timedelta(hours=i % 9)])) for i in range(n)]


def run(spark, tmp_path, batches, fold, **options):
    """The last state that the stream returns of each key, when the batches come one by one and then an event far ahead."""
    for n, rows in enumerate([*batches, [(-1, T0 + dt.timedelta(days=30), "q", "end", "request", "pending", 0, None)]]):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/part{n}")
    stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    name = f"ordered_{fold}_{random.randrange(10**9)}"
    out = ordered.ordered_fold_stream(stream, fold, **options)
    q = out.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    last = {}
    for r in spark.table(name).collect():
        last.setdefault(r["key"], []).append(tuple(r)[2:])
    return last


@pytest.mark.parametrize("fold", ["requests", "lifecycle"])
def test_shuffled_events_give_the_batch(spark, tmp_path, fold):
    rows = log(3, 120)
    rng = random.Random(1)
    # Each event is moved by less than the watermark: ten minutes are 60 events.
    order = sorted(range(len(rows)), key=lambda i: i + rng.randrange(30))
    mixed = [rows[i] for i in order]
    got = run(spark, tmp_path, [mixed[i : i + 40] for i in range(0, 120, 40)], fold)
    batch = worklog.fold_requests if fold == "requests" else worklog.replay_lifecycle
    want = {r["key"]: tuple(r)[2:] for r in batch(spark.createDataFrame(rows, EVENTS)).collect()}
    assert {k: v[-1] for k, v in got.items() if k != "end"} == want


def test_finished_items_leave(spark, tmp_path):
    at = lambda h: T0 + dt.timedelta(hours=h)
    event = lambda i, h, kind, key="a": (i, at(h), "q", key, kind, "pending", 1, None)
    batches = [[event(1, 0, "request"), event(2, 0.1, "succeeded")], [event(3, 5, "request", "b")], [event(4, 6, "request")]]
    # One hour after its end the item is gone, so the request at hour 6 finds none and counts from 1.
    gone = run(spark, tmp_path / "x", batches, "requests", retention_s=3600)
    kept = run(spark, tmp_path / "y", batches, "requests", retention_s=30 * 86_400)
    assert gone["a"][-1][-1] == 1 and kept["a"][-1][-1] == 2 and gone["a"][0][0] == kept["a"][0][0] == "succeeded"
