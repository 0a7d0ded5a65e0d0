"""Record formats against golden cases; odd input never fails a job."""

import json
import random

import pytest
from pyspark.sql import functions as F

from supplylens.operators import normalize as n
from supplylens.sources import schemas as S


def bronze(spark, *records):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in records], "content string")


def ranges(row):
    return [(r["introduced"], r["fixed"], r["last_affected"]) for r in row["ranges"]]


def osv(events, versions=(), **extra):
    return {"id": "X-1", "affected": [{"package": {"ecosystem": "npm", "name": "p"}, "ranges": [{"type": "SEMVER", "events": events}] if events else [], "versions": list(versions)}], **extra}


@pytest.mark.parametrize(
    ("events", "versions", "want", "flags"),
    [
        ([{"introduced": "3.1.0"}, {"fixed": "3.1.9"}, {"introduced": "4.2.0"}, {"last_affected": "4.2.6"}, {"introduced": "7"}, {"fixed": "8"}], [], [("3.1.0", "3.1.9", ""), ("4.2.0", "", "4.2.6"), ("7", "8", "")], []),
        ([{"introduced": "0"}, {"limit": "2.0.0"}], [], [("0", "2.0.0", "")], ["unbounded_range"]),
        ([{"introduced": "1.0"}], [], [("1.0", "", "")], ["no_upper_bound"]),
        ([{"introduced": "1.0"}, {"introduced": "2.0"}, {"last_affected": "2.5"}], [], [("1.0", "", ""), ("2.0", "", "2.5")], ["no_upper_bound"]),
        ([], [], [], ["empty_range"]),
        ([], ["1.0"], [], []),
        ([{"fixed": "1.0"}], [], [], ["empty_range"]),
    ],
)
def test_osv_ranges(spark, events, versions, want, flags):
    row = n.normalize_osv(bronze(spark, osv(events, versions)))[1].first()
    assert (ranges(row), row["flags"]) == (want, flags)


def test_osv_severity_and_specifics(spark):
    rec = osv([], severity=[{"type": "CVSS_V3", "score": "CVSS:3.1/AV:N"}, {"type": "CVSS_V3", "score": "7.5"}], published="2024-01-02T03:04:05Z")
    rec["affected"][0] |= {"database_specific": {"a": 1}, "ecosystem_specific": {"b": 2}}
    v, a = n.normalize_osv(bronze(spark, rec))
    assert [(s["score"], s["vector"]) for s in v.first()["severity"]] == [("", "CVSS:3.1/AV:N"), ("7.5", "")]
    assert json.loads(a.first()["database_specific"]) == {"a": 1, "ecosystem_specific": {"b": 2}}


@pytest.mark.parametrize(("a", "b", "want"), [('{"x":1}', None, {"x": 1}), (None, '{"y":2}', {"ecosystem_specific": {"y": 2}}), ("{}", "3", {"ecosystem_specific": 3}), ('"s"', "3", {"database_specific": "s", "ecosystem_specific": 3}), (None, None, None)])
def test_merge_db_spec(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(n.merge_db_spec(F.col("a"), F.col("b"))).first()[0]
    assert (json.loads(got) if got else None) == want


def nvd(match, **extra):
    return {"id": "CVE-1", "configurations": [{"nodes": [{"cpeMatch": [{"vulnerable": True, "criteria": "cpe:2.3:a:acme:libfoo:*:*", **match}]}]}], **extra}


@pytest.mark.parametrize(
    ("match", "want", "versions", "flags"),
    [
        ({}, [("0", "*", "")], [], ["all_versions_affected"]),
        ({"criteria": "cpe:2.3:a:acme:libfoo:1.2:*"}, [], ["1.2"], []),
        ({"versionStartExcluding": "1.0"}, [("1.0", "", "")], [], ["no_upper_bound"]),
        ({"versionEndIncluding": "3"}, [("", "", "3")], [], []),
    ],
)
def test_nvd_ranges(spark, match, want, versions, flags):
    row = n.normalize_nvd(bronze(spark, nvd(match)))[1].first()
    assert (row["vendor"], row["package_name"], ranges(row), row["versions"], row["flags"]) == ("acme", "libfoo", want, versions, flags)
    assert [r["introduced_exclusive"] for r in row["ranges"]] == (["versionStartExcluding" in match] if want else [])


def test_nvd_rejected_children_and_invulnerable(spark):
    child = {"cpeMatch": [{"vulnerable": True, "criteria": "cpe:2.3:a:x:deep:*:*"}, {"vulnerable": False, "criteria": "cpe:2.3:a:x:no:*:*"}]}
    rec = {"id": "CVE-2", "configurations": [{"nodes": [{"children": [{"children": [child]}]}]}], "weaknesses": [{"description": [{"lang": "en", "value": "CWE-79"}, {"lang": "en", "value": "NVD-CWE-noinfo"}]}]}
    dead = {"id": "CVE-3", "vulnStatus": "Rejected", "lastModified": "2024-01-01T00:00:00.000Z", **{"configurations": rec["configurations"]}}
    v, a = n.normalize_nvd(bronze(spark, rec, dead, "not json", "{}", json.dumps({"id": ""})))
    assert [r["package_name"] for r in a.collect()] == ["deep"]
    got = {r["id"]: r for r in v.collect()}
    assert set(got) == {"CVE-2", "CVE-3"} and json.loads(got["CVE-2"]["database_specific"]) == {"cwes": ["CWE-79"]} and got["CVE-3"]["withdrawn"] == got["CVE-3"]["modified"] is not None


def v5(default, versions, **cna):
    return {"cveMetadata": {"cveId": "CVE-9", "state": "PUBLISHED"}, "containers": {"cna": {"affected": [{"vendor": "v", "product": "p", "defaultStatus": default, "versions": versions}], **cna}}}


@pytest.mark.parametrize(
    ("default", "versions", "want", "flags"),
    [
        ("affected", [], [], ["empty_range", "unbounded_range"]),
        ("unaffected", [], [], ["empty_range"]),
        ("affected", [{"version": "0", "status": "unaffected", "lessThanOrEqual": "5"}], [("0", "5", "")], []),
        ("unaffected", [{"version": "1", "status": "affected", "lessThanOrEqual": "2"}], [("1", "", "2")], []),
        ("unaffected", [{"version": "1", "status": "affected", "lessThan": "2", "lessThanOrEqual": "3"}, {"version": "4", "status": "affected"}], [("1", "2", ""), ("4", "", "")], ["no_upper_bound"]),
    ],
)
def test_v5_ranges(spark, default, versions, want, flags):
    row = n.normalize_cve_v5(bronze(spark, v5(default, versions)))[1].first()
    assert (ranges(row), row["flags"]) == (want, flags)


def test_v5_status_lists_from_a_grammar(spark):
    """Status lists written from branches, each opened and perhaps closed in one of three ways, give one range for each, the closed ones first."""
    rng = random.Random(14)
    recs, want = [], []
    for i in range(60):
        entries, closed, left = [], [], []
        for major in rng.sample(range(1, 30), rng.randrange(1, 5)):
            start, fix = f"{major}.{rng.randrange(3)}", rng.randrange(4, 40)
            how = rng.choice(["last", "bound", "none"])
            entries.append({"version": start, "status": "affected"})
            if how == "last":
                entries.append({"version": f"{start}.{fix}", "status": "unaffected", "lessThanOrEqual": f"{start}.*"})
            elif how == "bound":
                entries.append({"version": start, "status": "unaffected", "lessThan": f"{start}.{fix}"})
            (left if how == "none" else closed).append((start, "" if how == "none" else f"{start}.{fix}", ""))
        recs.append({**v5("affected", entries), "cveMetadata": {"cveId": f"G-{i:03d}", "state": "PUBLISHED"}})
        want.append((closed + left, ["no_upper_bound"] if left else []))
    rows = n.normalize_cve_v5(bronze(spark, *recs))[1].orderBy("vuln_id").collect()
    assert [(ranges(r), r["flags"]) for r in rows] == want


def test_nvd_bounds_in_all_combinations(spark):
    """Each way to begin and to end a range, put together."""
    begins = [({}, "", False), ({"versionStartIncluding": "5.5"}, "5.5", False), ({"versionStartExcluding": "5.6"}, "5.6", True)]
    ends = [({"versionEndExcluding": "8.1"}, "8.1", ""), ({"versionEndIncluding": "8.2"}, "", "8.2")]
    for begin, introduced, exclusive in begins:
        for end, fixed, last in ends:
            row = n.normalize_nvd(bronze(spark, nvd({**begin, **end})))[1].first()
            assert (ranges(row), row["ranges"][0]["introduced_exclusive"], row["flags"]) == ([(introduced, fixed, last)], exclusive, [])


def test_configurations_without_nodes_hide_nothing(spark):
    rec = nvd({"versionEndExcluding": "3"})
    rec["configurations"].insert(0, {"operator": "AND"})
    assert n.normalize_nvd(bronze(spark, rec))[1].count() == 1


def test_v5_summary_severity_and_adp(spark):
    rec = v5("unaffected", [], descriptions=[{"lang": "fr", "value": "non"}, {"lang": "en-US", "value": "é" * 300}], metrics=[{"cvssV3_0": {"version": "3.0", "baseScore": 5}, "cvssV4_0": {"version": "4.0", "baseScore": 9}}])
    rec["containers"]["adp"] = [{"title": "t", "providerMetadata": {"shortName": "s"}, "affected": [{"product": "q"}], "metrics": [{"cvssV4_0": {"version": "4.0", "baseScore": 9.25}}]}]
    v, a = n.normalize_cve_v5(bronze(spark, rec))
    row = v.first()
    assert row["summary"] == "é" * 253 + "..." and [(s["type"], s["score"]) for s in row["severity"]][0] == ("CVSS_V3_0", "5.0") and row["severity"][1]["type"] == "CVSS_V4_0"
    assert {(r["source"], r["package_name"]) for r in a.collect()} == {("", "p"), ("s", "q")}


def test_rejects_keep_a_reason(spark):
    rows = spark.createDataFrame([("nvd", '{"id": "CVE-1"}'), ("nvd", "{broken"), ("nvd", '{"id": ""}'), ("else", '{"id": "x"}'), ("nvd", None)], "source string, content string")
    good, bad = n.split_rejects(rows, S.NVD, "id", ["nvd"])
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["malformed record", "malformed record", "missing id", "unknown source"]


def test_trees_are_read_to_their_ends_and_deeper_ones_rejected(spark):
    def record(i, depth):
        leaf = {"cpeMatch": [{"vulnerable": True, "criteria": f"cpe:2.3:a:v:p{depth}:1:*:*:*:*:*:*:*"}]}
        for _ in range(depth):
            leaf = {"cpeMatch": [{"vulnerable": True, "criteria": "cpe:2.3:a:v:inner:*"}], "children": [leaf]}
        return ("nvd", json.dumps({"id": i, "configurations": [{"nodes": [leaf]}]}))

    most = (S.NODE_DEPTH + 1) * S.NODE_ROUNDS - 1
    assert most >= 50
    depths = [0, S.NODE_DEPTH, S.NODE_DEPTH + 1, 11, 50, most, most + 1]
    rows = spark.createDataFrame([*[record(f"CVE-{d}", d) for d in depths], ("nvd", '{"id": "CVE-x"}'), ("what", "{}"), (None, "{}")], "source string, content string")
    got = {(r["vuln_id"], r["package_name"]): r["n"] for r in n.normalize_nvd(rows.filter("source = 'nvd'"))[1].groupBy("vuln_id", "package_name").agg(F.count("*").alias("n")).collect()}
    assert all(got[f"CVE-{d}", f"p{d}"] == 1 and got.get((f"CVE-{d}", "inner"), 0) == d for d in depths if d <= most)
    got = sorted((json.loads(r["content"]).get("id", ""), r["reason"]) for r in n.rejects(rows).collect())
    assert got == [("", "unknown source"), ("", "unknown source"), (f"CVE-{most + 1}", "configuration tree too deep")]


def test_debian_list(spark):
    text = "CVE-2031-0007 (A gear slips)\n\t{DSA-77-1}\n\t- gear 4.2.0-7\n\t[trixie] - gear <not-affected> (Feature is newer)\n\tNOTE: https://example.org/gear\nnoise\n\t- lost 1\nCVE-2031-0008\n  - x <unfixed>\nCVE-2031-0007 (later)\n"
    lines = spark.createDataFrame([("f", i, line) for i, line in enumerate(text.split("\n"))], "file string, pos int, line string")
    got = {r["cve_id"]: r for r in n.normalize_debian_notes(lines).collect()}
    assert set(got) == {"CVE-2031-0007", "CVE-2031-0008"} and got["CVE-2031-0007"]["description"] == "later"
    assert [(p["package"], p["release"], p["status"]) for p in got["CVE-2031-0008"]["packages"]] == [("x", "unstable", "unfixed")]
    first = n.normalize_debian_notes(lines.filter("pos < 9")).filter("cve_id = 'CVE-2031-0007'").first()
    assert first["advisories"] == ["DSA-77-1"] and first["notes"] == ["https://example.org/gear"]
    assert [(p["version"], p["status"], p["note"]) for p in first["packages"]] == [("4.2.0-7", "fixed", ""), ("", "not-affected", "Feature is newer")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('```json\n[{"cve_id": "C", "status": "affected", "confidence": "high", "reasoning": "r"}]\n```', [("C", "affected", "high")]),
        ('x [{"cve_id": "C", "status": "odd", "confidence": "odd"}, {"cve_id": "D', [("C", "under-review", "low")]),
        ("nothing", []), (None, []), ("[]", []), ("]x[", []), ('[{"status": "affected"}]', [("", "affected", "low")]),
    ],
)
def test_parse_assessments(spark, text, want):
    rows = n.parse_assessments(spark.createDataFrame([(text,)], "text string")).collect()
    assert [(r["cve_id"], r["status"], r["confidence"]) for r in rows] == want


def test_mapping_proposals(spark):
    df = spark.createDataFrame([("RPM httpd maps to upstream http_server.",), ("package curl equals curl",), ("libfoo in NVD is foo",), (None,)], "text string")
    assert {(r["rpm_name"], r["vuln_name"]) for r in n.extract_mapping_proposals(df).collect()} == {("httpd", "http_server."), ("libfoo", "foo")}


def test_platform_config(spark):
    content = json.dumps({"layers": [{"size": 5}, {"size": 7}], "created": "2024-01-01T00:00:00Z", "config": {"Labels": {"a": "b"}, "ExposedPorts": {"80/tcp": {}, "22/tcp": {}}}})
    row = n.platform_config(spark.createDataFrame([("p", content), ("q", "broken")], "platform_id string, content string")).orderBy("platform_id").collect()
    assert (row[0]["layer_count"], row[0]["compressed_size"], row[0]["labels"], row[0]["exposed_ports"]) == (2, 12, {"a": "b"}, ["22/tcp", "80/tcp"]) and row[1]["layer_count"] == 0


def test_dispatch_and_registration(spark):
    rows = spark.createDataFrame([("nvd", json.dumps(nvd({}))), ("ghsa", json.dumps(osv([{"introduced": "0"}])))], "source string, content string")
    v, a = n.normalize(rows)
    assert {(r["id"], r["source"]) for r in v.collect()} == {("CVE-1", "nvd"), ("X-1", "ghsa")} and a.count() == 2
    n.register_normalizer("mine", n.normalize_osv)
    assert "mine" in n.NORMALIZERS
    del n.NORMALIZERS["mine"]
