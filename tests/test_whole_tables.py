"""Queries that ask for all keys, whole texts and all rows, held against their SQL."""

import json
from collections import defaultdict

import duckdb
import pytest

from supplylens.operators import normalize
from supplylens.plans import ORACLES, QUERIES
from supplylens.plans.catalogue import Tables
from supplylens.plans.standins import TABLES


def same_rows(spark, sf_dir, name):
    sql = ORACLES[name]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    want = want.fetchall()
    got = [tuple(r[c] for c in names) for r in QUERIES[name](spark, sf_dir).collect()]
    assert want and sorted(map(str, got)) == sorted(map(str, want))
    return got


@pytest.mark.parametrize("name", ["scan_platforms", "affected_by_package", "affected_by_purl", "batch_query_affected", "batch_get", "tree_changes", "merge_coalesce", "merge_lww", "budgeted_top_k", "latency_quantiles", "alert_windows", "fold_requests", "replay_lifecycle", "resync_shard", "match_cves", "match_packages", "bulk_match", "bulk_advisories", "name_resolution", "list_images", "review_mappings", "invalid_reviews", "apply_reviews"])
def test_all_keys_are_asked(spark, sf_dir, name):
    same_rows(spark, sf_dir, name)


def test_whole_texts_are_parsed(spark, sf_dir):
    got = same_rows(spark, sf_dir, "parse_assessments")
    assert max(len(r[-1]) for r in got) > 1000


TEXTS = ["a [1] and ]", "if (x) { y } else }", 'she said "no" \\ "', "```json\n[1]\n``` end", "x" * 200_000, "日本 [}] ü", '"}], [{"']


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_texts_with_marks_of_json(spark, text):
    item = json.dumps({"cve_id": "C", "status": "affected", "confidence": "high", "reasoning": text}, ensure_ascii=False)
    cut = item[:-3] if not text.endswith(("\\", '"')) else item[:-5]
    answers = [f"Here: ```json\n[{item}]\n```", f"[{item}, {cut}", f'[{item}, {{"cve_id": "cut', f"[{item},\n```\n{item}]"]
    rows = normalize.parse_assessments(spark.createDataFrame(list(enumerate(answers)), "n int, text string")).collect()
    assert sorted((r["n"], r["reasoning"]) for r in rows) == [(0, text), (1, text), (2, text)] + [(3, text)] * 2


def test_all_advisories_are_sorted(spark, sf_dir):
    got = same_rows(spark, sf_dir, "sorted_advisories")
    by = {(r["source_package"], r["vuln_id"]): r for r in Tables(spark, sf_dir).advisories.collect()}
    assert len(got) == len(by) > 500
    rank = {"high": 1, "medium": 2, "low": 3}
    assert got == sorted(got, key=lambda k: (by[k]["status"] != "detected", rank[by[k]["confidence"]], k[1], k[0]))


def test_frequent_names_keeps_the_default_k(spark, sf_dir):
    assert len(same_rows(spark, sf_dir, "frequent_names")) > 100


def test_every_finding_of_every_platform_is_listed(spark, sf_dir):
    """All packages against all entries of the name they share with others, pair by pair; nothing is counted in place of being listed."""
    t = Tables(spark, sf_dir)
    entries = {(r["vuln_id"], int(r["package_name"][3:])) for r in t.affected.collect() if r["package_name"] and not r["purl"]}
    on = defaultdict(list)
    for r in t.platform_packages.collect():
        on[r["package_id"]].append(r["platform_id"])
    want, names, pairs = [], defaultdict(set), set()
    for p in t.packages.collect():
        name, version, found = f"PKG{p['package_id'] // 16}", tuple(map(int, p["version"].split("."))), defaultdict(set)
        for vuln, n in entries:
            if f"PKG{n // 16}" == name and n % 9 and version < (n % 60, 5):
                found[vuln].add(f"{n % 60}.5")
        listed = "; ".join(f"{v} {', '.join(sorted(f))}" for v, f in sorted(found.items()))
        want += [(i, name, p["version"], len(found), listed) for i in on[p["package_id"]] if found]
        pairs |= {(i, p["package_id"], v) for i in on[p["package_id"]] for v in found}
        names[name].add(p["package_id"])
    rows = QUERIES["scan_platforms"](spark, sf_dir)
    assert rows.columns == ["platform_id", "package_name", "package_version", "n", "findings"]
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    assert sum(w[3] for w in want) == len(pairs) > 500_000
    assert max(map(len, names.values())) == 16 and any(", " in w[4] for w in want)
