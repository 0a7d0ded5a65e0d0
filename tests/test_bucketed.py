"""Merges into bucketed tables: equal to the pure rules, only touched buckets rewritten, replays."""

import glob
import os
import random

import pytest

from supplylens.operators import bucketed, merge

SCHEMA = "vuln_id string, source string, name string, seq int"


def files(path):
    out = {}
    for f in glob.glob(f"{path}/data/*/*.parquet"):
        out.setdefault(int(f.split("__bucket=")[1].split("/")[0]), set()).add(os.path.basename(f))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def lww(t, s):
    return merge.merge_lww(t, s, ["vuln_id", "source"], "seq")


RULES = {"lww": lww, "by_source": merge.replace_by_source, "ignore": lambda t, s: merge.insert_ignore(t, s, ["vuln_id", "source"])}


@pytest.mark.parametrize("rule", sorted(RULES))
def test_equals_the_rule_and_rewrites_only_what_it_touches(spark, tmp_path, rule):
    rng = random.Random(3)
    old = spark.createDataFrame([(f"v{i}", "abc"[i % 3], f"n{rng.randrange(9)}", 1) for i in range(200)], SCHEMA)
    new = spark.createDataFrame([("v3", "a", "changed", 2), ("v4", "b", "older", 0), ("v900", "a", "new", 1), (None, None, "nulls", 1)], SCHEMA)
    path = f"{tmp_path}/t"
    bucketed.create_table(old, path, ["vuln_id", "source"], buckets=16)
    want = rows(RULES[rule](old, new))
    before = files(path)
    touched = bucketed.apply_merge(spark, path, new, RULES[rule])
    after = files(path)
    assert rows(bucketed.read_table(spark, path)) == want
    assert 1 <= len(touched) <= 4 and {b for b in after if after[b] != before[b]} == set(touched)
    # A replay changes nothing.
    assert bucketed.apply_merge(spark, path, new, RULES[rule]) == touched and rows(bucketed.read_table(spark, path)) == want


def test_a_bucket_can_lose_its_last_row(spark, tmp_path):
    old = spark.createDataFrame([("v1", "a", "x", 1)], SCHEMA)
    bucketed.create_table(old, f"{tmp_path}/t", ["vuln_id", "source"], buckets=4)
    bucketed.apply_merge(spark, f"{tmp_path}/t", old, lambda t, s: t.join(s, ["vuln_id", "source"], "left_anti"))
    assert bucketed.read_table(spark, f"{tmp_path}/t").count() == 0


def test_a_run_that_stopped_half_way_is_completed_by_the_next(spark, tmp_path):
    old = spark.createDataFrame([(f"v{i}", "a", "old", 1) for i in range(50)], SCHEMA)
    new = spark.createDataFrame([(f"v{i}", "a", "new", 2) for i in range(0, 60, 2)], SCHEMA)
    path = f"{tmp_path}/t"
    table = bucketed.create_table(old, path, ["vuln_id", "source"], buckets=8)
    # As if only the even buckets had been replaced.
    half = new.filter(table._bucket() % 2 == 0)
    bucketed.apply_merge(spark, path, half, lww)
    bucketed.apply_merge(spark, path, new, lww)
    assert rows(bucketed.read_table(spark, path)) == rows(lww(old, new))


def test_empty_source_and_only_touched_buckets_are_read(spark, tmp_path):
    path = f"{tmp_path}/t"
    old = spark.createDataFrame([(f"v{i}", "a", "x", 1) for i in range(20)], SCHEMA)
    bucketed.create_table(old, path, ["vuln_id", "source"], buckets=8)
    assert bucketed.apply_merge(spark, path, old.limit(0), lww) == []
    plan = bucketed.read_table(spark, path, [1, 2])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "IN (1,2)" in plan.replace("(1, 2)", "IN (1,2)")
