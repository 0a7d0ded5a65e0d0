"""Substring search against contains, quantiles of merged sketches against ranks, and pages by position."""

import datetime as dt
import random

import pytest

from supplylens.operators import cdc, lookups, ngrams, sketches

T0 = dt.datetime(2024, 1, 1)


def test_substrings_equal_contains(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abé-") for _ in range(n))
    names = [word(rng.randrange(0, 9)) for _ in range(200)] + [None, "a" * 50]
    needles = [word(rng.randrange(0, 5)) for _ in range(60)] + [None, "zzz", "a", "aaaa"]
    index = ngrams.build_ngrams(spark.createDataFrame([(n,) for n in names], "name string"))
    got = [tuple(r) for r in ngrams.substring_search(index, spark.createDataFrame([(n,) for n in needles], "needle string")).collect()]
    want = {(x, n) for x in needles if x for n in names if n and x in n}
    assert len(got) == len(set(got)) and set(got) == want


def test_only_the_rarest_gram_is_looked_at(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "PART", 10)
    names = [f"common{i}" for i in range(300)] + ["commonrare"]
    index = ngrams.build_ngrams(spark.createDataFrame([(n,) for n in names], "name string"))
    found = ngrams.substring_search(index, spark.createDataFrame([("commonrare",), ("ommo",)], "needle string"))
    assert found.filter("needle = 'commonrare'").count() == 1 and found.filter("needle = 'ommo'").count() == 301


def test_day_and_week_from_hourly_sketches(spark):
    rng = random.Random(7)
    rows = [("q" + str(i % 2), T0 + dt.timedelta(seconds=rng.randrange(14 * 86_400)), rng.choice([rng.random(), rng.expovariate(0.01), float(rng.randrange(5)), None])) for i in range(6000)]
    df = spark.createDataFrame(rows, "queue string, ts timestamp, v double")
    hourly = sketches.quantile_sketches(df, ["queue"], "v")
    daily = sketches.roll_up(hourly, ["queue"], "1 day")
    for table, days in ((daily, 1), (sketches.roll_up(daily, ["queue"], "7 days"), 7)):
        for r in sketches.sketch_quantiles(table).collect():
            end = r["window_start"] + dt.timedelta(days=days)
            values = sorted(v for q, t, v in rows if q == r["queue"] and v is not None and r["window_start"] <= t < end)
            assert (r["n"], r["least"], r["most"]) == (len(values), values[0], values[-1]) and r["total"] == pytest.approx(sum(values))
            for p, x in ((0.5, r["p50"]), (0.9, r["p90"]), (0.99, r["p99"])):
                below, upto = sum(v < x for v in values) / len(values), sum(v <= x for v in values) / len(values)
                assert below - sketches.RANK_ERROR <= p <= upto + sketches.RANK_ERROR
    assert sketches.quantile_sketches(df.limit(0), ["queue"], "v").count() == 0


def test_pages_by_position_give_every_row_once(spark):
    rng = random.Random(4)
    rows = [(f"v{i:03d}", rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"])) for i in range(83)]
    df = spark.createDataFrame(rows, "id string, t int, s string")
    order = [("t", "desc"), ("s", "asc"), ("id", "asc")]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, r[2] or "", r[0]))
    for size in (7, 30, 100):
        got, after = [], None
        while True:
            page = lookups.page_after(df, order, after, size).collect()
            got += [tuple(r) for r in page]
            if len(page) < size:
                break
            after = lookups.position(page[-1], order)
        assert got == want


def test_capped_work_lists_resume_with_ties(spark):
    v = spark.createDataFrame([("a", T0), ("b", T0), ("c", T0), ("d", T0 + dt.timedelta(1)), ("e", None)], "id string, updated_at timestamp")
    affected = spark.createDataFrame([(i, "p") for i in "abcd"] + [("z", "")], "vuln_id string, package_name string")
    for since, want in ((T0 - dt.timedelta(1), list("abcd")), (None, list("abcd"))):
        got, after = [], None
        while True:
            page = cdc.changed_vulns(v, affected, since, cap=2, after=after).collect()
            got += [r["id"] for r in page]
            if len(page) < 2:
                break
            after = (page[-1]["updated_at"], page[-1]["id"])
        assert got == want
