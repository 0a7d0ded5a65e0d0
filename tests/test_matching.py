"""Version decisions, vendors, names and advisories."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from supplylens.operators import matching as m
from supplylens.operators import normalize

RANGE = "struct<introduced:string,fixed:string,last_affected:string>"


def r(introduced="", fixed="", last=""):
    return (introduced, fixed, last)


def decide(spark, version, ranges, policy="production"):
    df = spark.createDataFrame([(version, ranges)], f"upstream_version string, ranges array<{RANGE}>")
    return m.match_versions(df, policy).withColumn("q", m.classify_range_quality(F.col("ranges"))).first()


@pytest.mark.parametrize(
    ("version", "ranges", "affected", "fixed", "quality", "flags"),
    [
        ("1.0", [], False, "", "none", ["no-ranges"]),
        ("1.5", [r("1.0", "2.0")], True, "2.0", "high", []),
        ("2.0", [r("1.0", "2.0")], False, "", "high", []),
        ("0.9", [r("1.0", "2.0")], False, "", "high", []),
        ("2.0", [r("1.0", last="2.0")], True, "", "high", []),
        ("5.0", [r("0", "*")], True, "", "all_versions", ["no-fix-available"]),
        ("5.0", [r("3.0")], True, "", "low", ["no-fixed-version"]),
        ("5.0", [r("1.0", "2.0"), r("3.0")], False, "", "high", []),
        ("5.0", [r("1.0", "2.0"), r("0", "*")], False, "", "high", []),
        ("5.0", [r("deadbeef", "cafebabe1")], False, "", "none", ["no-ranges"]),
        ("5.0", [r("1", "20240115")], False, "", "none", ["no-ranges"]),
        ("2.5", [r("1.0", "2.0"), r("2.0", "3.0"), r("0", "9")], True, "3.0", "high", []),
    ],
)
def test_production_rule(spark, version, ranges, affected, fixed, quality, flags):
    got = decide(spark, version, ranges)
    assert (got["affected"], got["fixed_version"], got["quality"], got["flags"]) == (affected, fixed, quality, flags)


def test_policies_differ_on_star(spark):
    ranges = [r("1.0", "2.0"), r("0", "*")]
    assert decide(spark, "5.0", ranges, "union")["affected"] is True
    assert decide(spark, "5.0", ranges, "first")["flags"] == ["no-fix-available"]
    assert decide(spark, "5.0", [r("1.0", "2.0"), r("1.0", "3.0")], "first")["fixed_version"] == "2.0"


def test_empty_and_null_ranges(spark):
    df = spark.createDataFrame([("1.0", None)], f"upstream_version string, ranges array<{RANGE}>")
    assert m.match_versions(df).first()["flags"] == ["no-ranges"]
    assert m.match_versions(df.limit(0)).count() == 0


MARKERS = ("npm", "uuidjs", "tagdiv", "org.")


def vendor_rule(vendor, rpm, name):
    """The rule in plain Python: unknown, or at one end of each other, or free of markers that the package doesn't bear."""
    v = (vendor or "").lower()
    ends = any(v.startswith(x) or v.endswith(x) or x.startswith(v) or x.endswith(v) for x in (rpm.lower(), name.lower()))
    return v == "" or ends or not any(k in v and k not in rpm.lower() for k in MARKERS)


def test_vendors_by_the_rule(spark):
    rng = random.Random(5)
    stems = ["zen", "Orb", "fir", "quill", "mast"]
    word = lambda: "".join(rng.choice([*stems, *MARKERS, "-"]) for _ in range(rng.randrange(1, 4)))
    rows = [(rng.choice([None, "", word(), word(), word()]), word(), word()) for _ in range(600)]
    got = spark.createDataFrame(rows, "v string, r string, n string").select("*", m.vendor_fits(F.col("v"), F.col("r"), F.col("n")).alias("fits")).collect()
    assert [(g["v"], g["r"], g["n"], g["fits"]) for g in got] == [(*r, vendor_rule(*r)) for r in rows]
    assert {g["fits"] for g in got} == {True, False}


SOURCES = "source_package string, upstream_version string, rpm_version string"
AFFECTED = f"vuln_id string, source string, vendor string, package_name string, ranges array<{RANGE}>"


NAMES = "rpm_name string, vuln_name string"


def test_match_cves_by_the_rule(spark):
    """Random vendors, names and ranges against the rule in plain Python: names in order, vendors of the name, the first range that holds the version."""
    rng = random.Random(11)
    stems = ["zen", "orb", "fir"]
    packages = [*stems, *[f"{x}{i}" for x in stems for i in (2, "3.1")], "tagdivorb"]
    vendors = ["", "zen", "fironline", "tagdiv", "npmers", "guild"]
    affected = [(f"V-{i % 40}", f"s{i}", rng.choice(vendors), rng.choice(stems), [(f"{rng.randrange(9)}.0", f"{rng.randrange(3, 12)}.{rng.randrange(5)}", "")]) for i in range(90)]
    sources = [(p, f"{rng.randrange(12)}.{rng.randrange(5)}", "r") for p in packages]
    got = m.match_cves(spark.createDataFrame(affected, AFFECTED), spark.createDataFrame(sources, SOURCES), spark.createDataFrame([], NAMES), scope="name").collect()
    number = lambda v: tuple(int(x) for x in v.split("."))
    want = {}
    for vuln in {a[0] for a in affected}:
        names = sorted({a[3] for a in affected if a[0] == vuln})
        for pkg, version, _ in sources:
            stem = pkg.rstrip("0123456789.")
            hit = next(((x, k) for x in names for k, kind in ((pkg, "direct"), (stem, "pattern")) if k == x and (kind == "direct" or stem != pkg)), None)
            if not hit:
                continue
            name, source = hit[0], "direct" if hit[0] == pkg else "pattern"
            mine = defaultdict(list)
            for a in sorted(affected, key=lambda a: (a[2], a[1])):
                if a[0] == vuln and a[3] == name:
                    mine[a[2]] += a[4]
            fits = {v: vendor_rule(v, pkg, name) for v in mine}
            if all(fits.values()) or not any(v for v in mine):
                ranges = [x for v in sorted(mine) for x in mine[v]]
            else:
                ranges = [x for v in sorted(mine) for x in mine[v] if fits[v]]
            inside = next((x for x in ranges if number(x[0]) <= number(version) < number(x[1])), None)
            first = inside or (ranges[0] if ranges else None)
            jump = bool(inside) and number(inside[1])[0] > number(version)[0] + 2
            status = "detected" if not ranges or jump else "affected" if inside else "not-affected"
            want[vuln, pkg] = (status, source, first[1] if first else "", ["no-ranges"] if not ranges else ["suspicious-version-jump"] if jump else [])
    assert {(g["vuln_id"], g["source_package"]): (g["status"], g["match_source"], g["upstream_fixed_version"], g["flags"]) for g in got} == want
    assert {w[0] for w in want.values()} == {"affected", "not-affected", "detected"}


def test_names_by_the_first_tier(spark):
    """Random tables of names, mappings and CPE entries against the tiers in plain Python."""
    rng = random.Random(8)
    letters = "uvw"
    word = lambda: rng.choice(["", "lib"]) + "".join(rng.choice(letters) for _ in range(2)) + rng.choice(["", "-t", "_t", "7", "7.5"])
    packages, index = sorted({word() for _ in range(60)}), {word() for _ in range(14)} | {rng.choice(letters) + rng.choice(letters) for _ in range(3)}
    mappings = [(p, rng.choice([*sorted(index), "nowhere"])) for p in packages[::7]]
    cpe = [(p, rng.choice(sorted(index))) for p in packages[::5]]

    def variants(n):
        stem, digits = n.rstrip("0123456789."), n.rstrip("0123456789")
        sure = {"lib" + n} if not n.startswith("lib") else set()
        if stem != n and n[-1].isdigit():
            sure |= {digits if digits.endswith(".") and "." in n and not n[len(stem) :].count(".") else stem, digits} - {""}
        sure |= {n.replace("-", "_")} if "-" in n else set()
        sure |= {n.replace("_", "-")} if "_" in n else set()
        return sure, {n[3:]} if n.startswith("lib") and len(n) > 3 else set()

    want = set()
    for p in packages:
        sure, unsure = variants(p)
        product = lambda names: {t for k, t in cpe if k in names}
        tiers = [("mapping", {t for k, t in mappings if k == p}), ("direct", {p}), ("pattern", sure), ("cpe", product({p})), ("cpe", product(sure)), ("uncertain", unsure)]
        for i, (kind, names) in enumerate(tiers):
            hits = sorted(names & index)
            if hits:
                want |= {(p, h, kind) for h in (hits[:1] if i == 4 else hits)}
                break
    one = lambda rows, cols: spark.createDataFrame(rows, cols)
    got = m.resolve_names(one([(p,) for p in packages], "source_package string"), one([(n,) for n in index], "name string"), one(cpe, "name string, product string"), one(mappings, NAMES)).collect()
    assert {tuple(g) for g in got} == want and {w[2] for w in want} >= {"mapping", "direct", "pattern", "uncertain"}


def test_to_osv(spark):
    cols = "source_package string, vuln_id string, status string, confidence string, upstream_version string, rpm_version string, upstream_fixed_version string, distro_fixed_version string, cvss_score string, notes string"
    rows = [("p", "CVE-1", "fixed", "high", "1", "1-1", "2", "2-1", "7.5", "n" * 600), ("p", "CVE-2", "affected", "high", "1", "1-1", "3", "", "", None), ("q", "CVE-3", "detected", "low", "1", "1", "3", "", None, "x")]
    got = {g["vuln_id"]: g["doc"] for g in m.to_osv(spark.createDataFrame(rows, cols), "ADV-", "Some Linux", "pkg:rpm/some/").collect()}
    assert '{"fixed":"2-1"}' in got["CVE-1"] and '"severity":[{"type":"CVSS_V3","score":"7.5"}]' in got["CVE-1"] and "n" * 501 not in got["CVE-1"]
    assert '{"limit":"3"}' in got["CVE-2"] and '"severity"' not in got["CVE-2"]
    assert '"events":[{"introduced":"0"}]' in got["CVE-3"]


def bulk_tables(spark):
    affected = spark.createDataFrame(
        [
            ("CVE-1", "nvd", "", "curl", [r("1.0", "8.0")]),
            ("CVE-2", "osv", "", "Curl", [r("1.0", "2.0"), r("0", "*")]),
            ("CVE-3", "nvd", "", "libcurl", [r("3.0")]),
            ("CVE-4", "nvd", "", "curl", []),
            ("CVE-1", "osv", "", "libcurl", [r("9.0", "9.9")]),
        ],
        AFFECTED,
    )
    sources = spark.createDataFrame([("curl", "7.5", "7.5-1"), ("other", "1.0", "1.0-1")], SOURCES)
    none = (spark.createDataFrame([], "name string, product string"), spark.createDataFrame([], "rpm_name string, vuln_name string"))
    return affected, sources, *none


def test_match_packages(spark):
    affected, sources, cpe, mappings = bulk_tables(spark)
    adv, learned = m.match_packages(sources, affected, cpe, mappings)
    got = {a["vuln_id"]: (a["status"], a["confidence"], a["upstream_fixed_version"], a["match_source"]) for a in adv.collect()}
    # Only the first tier's names count, so libcurl's entries do not.
    assert got == {"CVE-1": ("affected", "high", "8.0", "direct"), "CVE-2": ("not-affected", "high", "2.0", "direct"), "CVE-4": ("detected", "low", "", "direct")}
    assert learned.count() == 0
    _, learned = m.match_packages(spark.createDataFrame([("curl8", "7.5", "1")], SOURCES), affected, cpe, mappings)
    assert [(x["rpm_name"], x["vuln_name"], x["match_source"]) for x in learned.collect()] == [("curl8", "curl", "pattern")]


def test_bulk_match_is_the_union_of_all_names(spark):
    affected, sources, cpe, mappings = bulk_tables(spark)
    got = {x["vuln_id"]: (x["vuln_name"], x["fixed_version"], x["confidence"]) for x in m.bulk_match(sources, m.build_vuln_index(affected), cpe, mappings).collect()}
    assert got == {"CVE-1": ("curl", "8.0", "medium"), "CVE-2": ("curl", "", "medium"), "CVE-3": ("libcurl", "", "low")}


def test_bulk_advisories_take_the_first_name(spark):
    affected, sources, cpe, mappings = bulk_tables(spark)
    got = {x["vuln_id"]: (x["status"], x["confidence"], x["match_type"]) for x in m.bulk_advisories(sources, m.build_vuln_index(affected), cpe, mappings).collect()}
    assert got == {"CVE-1": ("detected", "medium", "name:curl"), "CVE-2": ("detected", "low", "name:curl"), "CVE-3": ("detected", "low", "name:libcurl")}


TYPED = "array<struct<range_type:string,introduced:string,introduced_exclusive:boolean,fixed:string,last_affected:string>>"


def typed(kind, introduced="", fixed="", last="", exclusive=False):
    return (kind, introduced, exclusive, fixed, last)


@pytest.mark.parametrize(
    ("version", "ranges", "affected", "flags"),
    [
        ("1.5", [typed("GIT", "1.0", "2.0")], False, ["no-ranges"]),
        ("1.5", [typed("semver", "1.0", "2.0")], True, []),
        ("2.0.0-rc.1", [typed("SEMVER", "1.0.0", "2.0.0")], True, []),
        ("2.0-1", [typed("maven", "1.0", "2.0")], False, []),
        ("2.0~rc1", [typed("rpm", "1.0", "2.0")], True, []),
        ("1.0", [typed("", "1.0", "2.0", exclusive=True)], True, []),
        ("1.5", [typed("custom", "1.0", "2.0")], True, ["vendor-specific-order"]),
        ("1.5", [typed("GIT", "1.0", "2.0"), typed(None, "1.0", "1.6")], True, []),
        ("1.5", None, False, ["no-ranges"]),
    ],
)
def test_the_type_of_a_range_chooses_the_order(spark, version, ranges, affected, flags):
    df = spark.createDataFrame([(version, ranges, ["seen"])], f"upstream_version string, ranges {TYPED}, flags array<string>")
    got = m.match_versions(df).first()
    assert (got["affected"], got["flags"], got["record_flags"]) == (affected, flags, ["seen"])


def test_exclusive_starts_on_request(spark):
    df = spark.createDataFrame([("1.0", [typed("", "1.0", "2.0", exclusive=True)]), ("1.0", [typed("", "1.0", exclusive=True)]), ("1.1", [typed("", "1.0", exclusive=True)])], f"upstream_version string, ranges {TYPED}")
    assert [r["affected"] for r in m.match_versions(df).collect()] == [True, True, True]
    assert [r["affected"] for r in m.match_versions(df, honor_exclusive=True).collect()] == [False, False, True]


def test_only_ordered_types_on_request(spark):
    df = spark.createDataFrame([("1.5", [typed("SEMVER", "3.0", "4.0"), typed("custom", "1.0", "2.0")])], f"upstream_version string, ranges {TYPED}")
    assert m.match_versions(df, ordered=["SEMVER"]).first()["affected"] is False and m.match_versions(df).first()["affected"] is True


def records(spark):
    """NVD and OSV records of a few packages as they land."""
    cpe = lambda name, **k: {"vulnerable": True, "criteria": f"cpe:2.3:a:guild:{name}:*:*", **k}
    nvd = {"id": "CVE-7", "configurations": [{"nodes": [{"cpeMatch": [cpe("orb", versionStartExcluding="1.0", versionEndExcluding="3.0"), cpe("fir")]}]}], "metrics": {"cvssMetricV31": [{"cvssData": {"version": "3.1", "baseScore": 8.1, "vectorString": "x"}}]}}
    osv = {"id": "CVE-8", "affected": [{"package": {"ecosystem": "npm", "name": "zen"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "2.0.0"}]}]}]}
    odd = {"id": "CVE-9", "configurations": [{"operator": "AND"}, {"nodes": [{"cpeMatch": [cpe("late", versionEndIncluding="9")]}]}]}
    rows = [("nvd", json.dumps(nvd)), ("pypa", json.dumps(osv)), ("nvd", json.dumps(odd))]
    return normalize.normalize(spark.createDataFrame(rows, "source string, content string"), ["nvd", "pypa"])


def test_normalised_records_meet_every_matcher(spark):
    v, a = (df.cache() for df in records(spark))
    sources = spark.createDataFrame([("orb", "1.0", "1"), ("zen", "2.0.0-rc.2", "1"), ("fir", "5", "1"), ("late", "9", "1")], SOURCES)
    none, cpe = spark.createDataFrame([], NAMES), spark.createDataFrame([], "name string, product string")
    got = {g["source_package"]: (g["vuln_id"], g["status"]) for g in m.match_cves(a, sources, none, scope="name").collect()}
    assert got == {"orb": ("CVE-7", "affected"), "zen": ("CVE-8", "affected"), "fir": ("CVE-7", "detected"), "late": ("CVE-9", "affected")}
    strict = {g["source_package"]: g["status"] for g in m.match_cves(a, sources, none, honor_exclusive=True, scope="name").collect()}
    assert strict == {"orb": "not-affected", "zen": "affected", "fir": "detected", "late": "affected"}
    adv = m.match_packages(sources, a, cpe, none)[0]
    assert {g["source_package"] for g in adv.collect()} == set(got)
    index = m.build_vuln_index(a)
    assert {x["source_package"] for x in m.bulk_match(sources, index, cpe, none).collect()} >= {"orb", "zen", "late"}
    assert m.bulk_advisories(sources, index, cpe, none).count() == 4
    packages = sources.select(F.monotonically_increasing_id().alias("package_id"), F.col("source_package").alias("name"), F.col("upstream_version").alias("version"), F.lit("").alias("purl"))
    found = m.scan_platforms(packages.select(F.lit(1).alias("platform_id"), "package_id"), packages, a, v)
    assert {(f["package_name"], f["vuln_id"], f["severity"]) for f in found.collect()} == {("orb", "CVE-7", "CVSS_V3_1"), ("fir", "CVE-7", "CVSS_V3_1"), ("zen", "CVE-8", None), ("late", "CVE-9", None)}


def test_listed_findings_are_those_of_single_rows(spark):
    """A list holds all that the scan gives a row each: by purl and name, with several fixes, with and without severity; packages on two platforms, on none and without findings."""
    ranges = lambda *fixes: [("", "", f, "") for f in fixes]
    affected = [("V2", "orb", "", ranges("3.0")), ("V2", "orb", "", ranges("2.0")), ("V1", "Orb", "", ranges("4.0")), ("V3", "", "pkg:a/zen", ranges("9")), ("V4", "orb", "", ranges("0.5")), ("V5", "fir", "", ranges("9"))]
    affected = spark.createDataFrame(affected, "vuln_id string, package_name string, purl string, ranges array<struct<range_type:string,introduced:string,fixed:string,last_affected:string>>")
    packages = spark.createDataFrame([(1, "ORB", "1.0", None), (2, "orb", "2.5", ""), (3, "zen", "1", "pkg:a/zen"), (4, "orb", "8", ""), (5, "fir", "1", ""), (6, "orb", "1.0", "")], "package_id long, name string, version string, purl string")
    v = spark.createDataFrame([("V1", [("CVSS_V3", "x")]), ("V2", [])], "id string, severity array<struct<type:string,score:string>>")
    on = spark.createDataFrame([(7, 1), (7, 1), (8, 1), (7, 2), (8, 3), (8, 4), (8, 6)], "platform_id long, package_id long")
    listed = m.list_findings(on, packages, affected, v)
    got = {(r["platform_id"], r["package_id"]): [tuple(f) for f in r["findings"]] for r in listed.collect()}
    both = [("V1", "4.0", "CVSS_V3"), ("V2", "2.0, 3.0", None)]
    assert got == {(7, 1): both, (8, 1): both, (8, 6): both, (7, 2): [("V1", "4.0", "CVSS_V3"), ("V2", "3.0", None)], (8, 3): [("V3", "9", None)]}
    single = ["platform_id", "vuln_id", "package_name", "package_version", "fixed_versions", "severity"]
    rows = listed.select("platform_id", "package_name", "package_version", F.inline("findings")).select(*single).collect()
    assert sorted(map(str, rows)) == sorted(map(str, m.scan_platforms(on, packages, affected, v).select(*single).collect())) and len(rows) == 9


def test_findings_are_shuffled_as_lists(spark, monkeypatch):
    """No shuffle has a row for each finding of a package; a package on many platforms is dealt over parts, and each pair of platform and package counts once."""
    ranges = [("", "", "9", "")]
    affected = [(f"V{i}", "orb", "", ranges) for i in range(40)] + [(None, "orb", "", [("", "", "8", "")]), ("V1", "orb", "", [("", "", "7", "")])]
    affected = spark.createDataFrame(affected, "vuln_id string, package_name string, purl string, ranges array<struct<range_type:string,introduced:string,fixed:string,last_affected:string>>")
    packages = spark.createDataFrame([(1, "orb", "1", ""), (2, "Orb", "8.5", ""), (3, "fir", "1", "")], "package_id long, name string, version string, purl string")
    v = spark.createDataFrame([("V1", [("CVSS_V3", "x")])], "id string, severity array<struct<type:string,score:string>>")
    on = spark.createDataFrame([(i, 1) for i in range(50)] * 2 + [(None, 1), (3, 2), (3, 3), (4, None)], "platform_id long, package_id long")
    monkeypatch.setattr(m, "PLATFORMS_AT_ONCE", 7)
    assert m._dealt(on, packages)[0].filter("package_id = 1").select("part").distinct().count() > 5
    got = m.list_findings(on, packages, affected, v, columns={"n": F.size("findings"), "first": F.col("findings")[1]})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "package_id" in x and "vuln_id" in x]
    assert got.columns == ["platform_id", "package_id", "package_name", "package_version", "n", "first"]
    rows = sorted(got.collect(), key=str)
    assert sorted((r["platform_id"], r["package_id"], r["n"]) for r in rows if r["platform_id"] is not None) == sorted([(i, 1, 41) for i in range(50)] + [(3, 2, 40)])
    assert [(r["package_id"], r["n"]) for r in rows if r["platform_id"] is None] == [(1, 41)]
    assert {tuple(r["first"]) for r in rows if r["package_id"] == 1} == {("V0", "9", None)}
    single = m.scan_platforms(on, packages, affected, v).collect()
    assert len(single) == len(set(single)) == 51 * 41 + 40
    assert {(r["vuln_id"], r["fixed_versions"], r["severity"]) for r in single if r["package_name"] == "orb"} >= {("V1", "7, 9", "CVSS_V3"), (None, "8", None), ("V39", "9", None)}


@pytest.mark.parametrize("strict", [False, True])
def test_interval_search_equals_the_rule_pair_by_pair(spark, strict):
    """Random typed ranges, with and without keys, in one order and in several, with open ends: the join by ranks finds what comparing all pairs finds."""
    rng = random.Random(4)
    version = lambda: rng.choice(["", "*", "0", "1.0", "2", "2.0-foo-bar", "deadbeef"] + [f"{rng.randrange(9)}.{rng.randrange(4)}" for _ in range(12)] + ["3.0-rc1", "3.0~a"])
    kinds = ["", "", "semver", "rpm", "maven", "GIT", "custom"]
    entries = []
    for i in range(120):
        kind, mixed = rng.choice(kinds), rng.random() < 0.2
        ranges = [(rng.choice(kinds) if mixed else kind, version(), rng.random() < 0.5, version() if rng.random() < 0.6 else "", version() if rng.random() < 0.3 else "") for _ in range(rng.randrange(4))]
        entries.append((rng.choice("abc"), f"e{i}", ranges))
    points = sorted({(g, v) for g in "abcd" for v in (version() for _ in range(25)) if v not in ("", "*")})
    entries_df = spark.createDataFrame(entries, f"group string, entry string, ranges {TYPED}")
    points_df = spark.createDataFrame(points, "group string, upstream_version string")
    got = {tuple(r) for r in m.affected_versions(points_df, entries_df, strict).select("group", "upstream_version", "entry", "fixed_version").collect()}
    pairs = m.match_versions(points_df.join(entries_df, "group"), honor_exclusive=strict).filter("affected")
    assert got == {tuple(r) for r in pairs.select("group", "upstream_version", "entry", "fixed_version").collect()} and len(got) > 100
