"""Merges, change detection, lookups and histories: properties and odd rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from supplylens.operators import aggregates, cdc, joins, lookups, matching, merge, windows

T = dt.datetime


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_merge_lww_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k int, v string, s int")
    source = spark.createDataFrame([("c", 1, 5), ("d", 3, 1), ("e", 2, 1), ("old", 1, 4)], "v string, k int, s int")
    once = merge.merge_lww(target, source, ["k"], "s")
    assert rows(once, "k", "v") == [(1, "c"), (2, "e"), (3, "d")]
    assert rows(merge.merge_lww(once, source, ["k"], "s"), "k", "v") == rows(once, "k", "v")


def test_replace_by_source_leaves_other_sources(spark):
    t = spark.createDataFrame([("C1", "nvd", 1), ("C1", "nvd", 2), ("C1", "osv", 3)], "vuln_id string, source string, x int")
    s = spark.createDataFrame([("C1", "nvd", 9)], "vuln_id string, source string, x int")
    once = merge.replace_by_source(t, s)
    assert rows(once, "source", "x") == [("nvd", 9), ("osv", 3)] == rows(merge.replace_by_source(once, s), "source", "x")
    assert merge.replace_by_source(t, s.limit(0)).count() == 3


def test_review_guard(spark):
    schema = "source_package string, vuln_id string, status string, reviewed_at timestamp"
    t = spark.createDataFrame([("p", "C1", "fixed", T(2024, 1, 1)), ("p", "C2", "detected", None)], schema)
    s = spark.createDataFrame([("p", "C1", "affected", None), ("p", "C2", "affected", None), ("p", "C3", "detected", None)], schema)
    assert rows(merge.merge_unreviewed(t, s), "vuln_id", "status") == [("C1", "fixed"), ("C2", "affected"), ("C3", "detected")]


def test_merge_checkpoint(spark):
    schema = "source string, checkpoint_value string, items_synced long, error_message string"
    t = spark.createDataFrame([("a", "1", 5, "bad"), ("b", "1", 5, None)], schema)
    s = spark.createDataFrame([("a", "2", 3, None), ("b", "9", 3, "boom"), ("c", "1", 1, None)], schema)
    assert rows(merge.merge_checkpoint(t, s), *t.columns) == [("a", "2", 8, None), ("b", "1", 5, "boom"), ("c", "1", 1, None)]


def test_insert_ignore_and_retention(spark):
    a = spark.createDataFrame([(1, 1)], "p int, q int")
    assert merge.insert_ignore(a, spark.createDataFrame([(1, 1), (2, 2), (2, 2)], "p int, q int"), ["p", "q"]).count() == 2
    items = spark.createDataFrame([("k1", "succeeded", T(2024, 1, 1)), ("k2", "succeeded", T(2024, 1, 9)), ("k3", "dead_letter", T(2024, 1, 1)), ("k4", "pending", None)], "key string, status string, updated_at timestamp")
    assert rows(merge.retain(items, T(2024, 1, 10)), "key") == [("k2",), ("k3",), ("k4",)]
    assert rows(merge.retain(items, T(2024, 1, 10), purge_dead=True), "key") == [("k2",), ("k4",)]


def test_second_run_sees_no_change(spark):
    new = spark.createDataFrame([("C1", "nvd", "h1"), ("C2", "nvd", "h2")], "vuln_id string, source string, raw_hash string")
    assert cdc.changed_records(new, new).count() == 0 and cdc.changed_records(new, new.limit(0)).count() == 2
    epss = spark.createDataFrame([("C1", 0.5), ("C2", 0.515)], "cve_id string, score double")
    assert cdc.epss_changes(epss, epss).count() == 0
    assert rows(cdc.epss_changes(epss, epss.withColumn("score", F.col("score") - F.when(F.col("cve_id") == "C2", 0.02).otherwise(0.005))), "cve_id") == [("C2",)]
    notes = spark.createDataFrame([("C1", "debian", ("x",))], "cve_id string, vendor string, content struct<a: string>")
    changed, hashes = cdc.note_changes(notes, spark.createDataFrame([], "cve_id string, vendor string, hash string"))
    assert changed.count() == 1 and cdc.note_changes(notes, hashes)[0].count() == 0


def test_kev_changes(spark):
    kev = spark.createDataFrame([("C1",), ("C2",)], "cve_id string")
    assert cdc.kev_changes(kev, kev.limit(0), False).count() == 2
    assert cdc.kev_changes(kev, kev, True).count() == 2 and cdc.kev_changes(kev, kev, False).count() == 0


def test_page_clamps(spark):
    df = spark.range(2000)
    assert lookups.page(df, ["id"]).count() == 100 and lookups.page(df, ["id"], 5000).count() == 1000 and lookups.page(df, ["id"], -1, 1950).count() == 50


def test_related_is_one_hop_and_symmetric(spark):
    v = spark.createDataFrame([("A", ["B", "X"]), ("B", ["C"]), ("C", [])], "id string, aliases array<string>")
    assert rows(lookups.related(v), "id", "related_id") == [("A", "B"), ("B", "A"), ("B", "C"), ("C", "B"), ("X", "A")]


def test_diff_matches_its_pairs_form(spark):
    pp = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 12), (2, 12)], "platform_id int, package_id int")
    want = [(10, "removed"), (12, "added")]
    assert rows(joins.diff_packages(pp, 1, 2), "package_id", "change") == want
    assert rows(joins.diff_packages_pairs(pp, spark.createDataFrame([(1, 2)], "from_id int, to_id int")), "package_id", "change") == want


def test_tag_history(spark):
    e = spark.createDataFrame([(1, "t", T(2024, 1, 1), "A"), (2, "t", T(2024, 1, 2), "A"), (3, "t", T(2024, 1, 3), "B"), (4, "t", T(2024, 1, 4), "A"), (5, "u", T(2024, 1, 1), None)], "event_id int, tag string, ts timestamp, image_id string")
    got = rows(windows.tag_history(e, ["tag"]), "tag", "image_id", "valid_from", "current")
    assert got == sorted([("t", "A", T(2024, 1, 1), False), ("t", "B", T(2024, 1, 3), False), ("t", "A", T(2024, 1, 4), True), ("u", None, T(2024, 1, 1), True)], key=str)


def test_budgeted_top_k(spark):
    items = spark.createDataFrame([("q", f"k{i}", "pending", i, T(2024, 1, 1), None if i % 2 else T(2030, 1, 1)) for i in range(10)], "queue string, key string, status string, priority int, created_at timestamp, not_before timestamp")
    busy = spark.createDataFrame([("q", 2)], "queue string, n long")
    assert rows(windows.budgeted_top_k(items, busy, 5, T(2024, 6, 1), 10), "key", "rank") == [("k5", 3), ("k7", 2), ("k9", 1)]
    assert windows.budgeted_top_k(items, busy, 1, T(2024, 6, 1), 10).count() == 0


def test_carry_header(spark):
    lines = spark.createDataFrame([("f", 0, "x"), ("f", 1, "H1"), ("f", 2, "y"), ("f", 3, "H2")], "file string, pos int, line string")
    assert [r["header"] for r in windows.carry_header(lines, "^H", "file").orderBy("pos").collect()] == [None, "H1", "H1", "H2"]


def test_rollup_and_report_on_empty_tables(spark):
    f = spark.createDataFrame([], "scan_id int, severity string")
    assert aggregates.severity_rollup(f).count() == 0
    ours = spark.createDataFrame([], "vuln_id string, package_name string, affected boolean")
    got = aggregates.accuracy_report(ours, ours).first()
    assert (got["both"], got["recall"], got["precision"]) == (0, None, None)


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("q", x) for x in (0.1, 2.0, 2.0, 99.0, None)], "queue string, x double")
    assert rows(aggregates.latency_histogram(df, ["queue"], "x", (1, 10)), "le", "n") == sorted([(1.0, 1), (10.0, 3), (None, 4)], key=str)


def test_merge_assessments_cap(spark):
    cand = spark.createDataFrame([("p", f"C{i:02d}") for i in range(4)], "source_package string, vuln_id string")
    told = spark.createDataFrame([("p", "C00", "affected", "high"), ("p", "C03", "affected", "high")], "source_package string, vuln_id string, status string, confidence string")
    assert rows(matching.merge_assessments(cand, told, 2), "vuln_id", "status") == [("C00", "affected"), ("C01", "under-review"), ("C02", "detected"), ("C03", "detected")]


@pytest.mark.parametrize("names", [["libx"], []])
def test_unmapped_candidates(spark, names):
    sources = spark.createDataFrame([("foo-bar",), ("libx",), ("ab",)], "source_package string")
    affected = spark.createDataFrame([("C1", "foolib"), ("C2", "foolib"), ("C3", "myfoo"), ("C4", "cab")] + [("C5", n) for n in names], "vuln_id string, package_name string")
    told = spark.createDataFrame([("ab", "text")], "name string, description string")
    findings = spark.createDataFrame([("AB", "C9")], "package_name string, vuln_id string")
    got = {r["source_package"]: (r["similar"], r["description"], r["example_cve"]) for r in matching.unmapped_candidates(sources, affected, told, findings).collect()}
    assert got["foo-bar"] == ("foolib:2,myfoo:1", "", None) and got["ab"] == ("cab:1", "text", "C9") and ("libx" in got) == (not names)
