"""Histories on file against the full recomputation, for any order and batching of events."""

import random

import pytest

from supplylens.operators import history, windows

SCHEMA = "repository string, tag string, event_id long, ts int, image_id string, retracted boolean"
KEYS = ("repository", "tag")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_batching_gives_the_full_history(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = [("r", f"t{rng.randrange(6)}", i, rng.randrange(40), rng.choice(["a", "a", "b", None]), False) for i in range(60)]
    gone = [(e[0], e[1], e[2], None, None, True) for e in rng.sample(events, 12)]
    stream = events + gone + rng.sample(events, 15)
    rng.shuffle(stream)
    h = history.History(f"{tmp_path}/h", KEYS)
    history.create_history(h, spark.createDataFrame(stream[:20], SCHEMA).filter("not retracted"), buckets=4)
    taken = [e for e in stream[:20] if not e[5]]
    for i in range(20, len(stream), 30):
        touched = history.apply_events(spark, h, spark.createDataFrame(stream[i : i + 30], SCHEMA))
        taken += stream[i : i + 30]
        assert touched
    back = {e[2] for e in taken if e[5]}
    valid = {e[2]: e for e in taken if not e[5] and e[2] not in back}
    want = windows.tag_history(spark.createDataFrame(list(valid.values()), SCHEMA), list(KEYS))
    assert rows(history.read_history(spark, h)) == rows(want)


def test_a_batch_that_comes_again_changes_nothing_and_only_its_buckets_are_touched(spark, tmp_path):
    h = history.History(f"{tmp_path}/h", KEYS)
    first = [("r", f"t{i}", i, i, "a", False) for i in range(30)]
    history.create_history(h, spark.createDataFrame(first, SCHEMA), buckets=16)
    late = spark.createDataFrame([("r", "t7", 99, 3, "b", False)], SCHEMA)
    assert len(history.apply_events(spark, h, late)) == 1
    once = rows(history.read_history(spark, h))
    assert ("r", "t7", "b", 3, 7, False) in once and ("r", "t7", "a", 7, None, True) in once
    history.apply_events(spark, h, late)
    assert rows(history.read_history(spark, h)) == once
    assert history.apply_events(spark, h, late.limit(0)) == []
