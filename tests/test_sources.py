"""Readers and sinks on small files."""

import gzip
import json
import zipfile

from supplylens.operators.normalize import normalize_kev, normalize_nvd
from supplylens.sources import readers, sinks


def test_tree(spark, tmp_path):
    (tmp_path / "adv/2024").mkdir(parents=True)
    (tmp_path / "adv/2024/a.json").write_text("{}")
    (tmp_path / "adv/readme.md").write_text("no")
    got = readers.read_advisory_tree(spark, str(tmp_path), "ghsa", "adv", "*.json").collect()
    assert [(r["key"], r["content"], len(r["raw_hash"])) for r in got] == [("ghsa/adv/2024/a.json", "{}", 64)]


def test_nvd_feed(spark, tmp_path):
    with gzip.open(tmp_path / "f.json.gz", "wt") as f:
        json.dump({"vulnerabilities": [{"cve": {"id": "CVE-1"}}, {"cve": {"id": ""}}, {}]}, f)
    rows = readers.read_nvd_feed(spark, str(tmp_path / "f.json.gz"))
    assert [r["vuln_id"] for r in rows.collect()] == ["CVE-1"] and normalize_nvd(rows)[0].first()["id"] == "CVE-1"


def test_osv_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "npm.zip", "w") as z:
        z.writestr("A.json", "{}")
        z.writestr("b.txt", "x")
    assert [r["key"] for r in readers.read_osv_zip(spark, str(tmp_path / "npm.zip")).collect()] == ["osv/npm/A.json"]


def test_kev(spark, tmp_path):
    (tmp_path / "kev.json").write_text(json.dumps({"catalogVersion": "1", "vulnerabilities": [{"cveID": "CVE-1", "dateAdded": "2024-02-03"}, {"cveID": ""}]}))
    got = normalize_kev(readers.read_kev(spark, str(tmp_path / "kev.json"))).collect()
    assert [(r["cve_id"], str(r["date_added"])) for r in got] == [("CVE-1", "2024-02-03")]


def test_epss(spark, tmp_path):
    (tmp_path / "e.csv").write_text("#model_version:v1,score_date:2024-01-02T00:00:00+0000\ncve,epss,percentile\nCVE-1,0.5,0.9\nCVE-2,junk,\nshort,1\n")
    got = sorted(tuple(r) for r in readers.read_epss(spark, str(tmp_path / "e.csv")).select("cve_id", "score", "model_version").collect())
    assert got == [("CVE-1", 0.5, "v1"), ("CVE-2", 0.0, "v1")]


def test_debian_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "list").write_text("CVE-1\n\tx\n\ty\n")
    assert [r["line"] for r in readers.read_debian_list(spark, str(tmp_path / "list")).orderBy("pos").collect()] == ["CVE-1", "\tx", "\ty", ""]


def test_sboms_and_manifests(spark, tmp_path):
    (tmp_path / "sboms").mkdir()
    (tmp_path / "sboms/abc.spdx.json").write_text("{}")
    assert readers.read_sboms(spark, str(tmp_path / "sboms")).first()["platform_id"] == "sha256:abc"
    assert readers.read_manifests(spark, str(tmp_path / "sboms/abc.spdx.json")).first()["content"] == "{}"


def test_map_files(spark, tmp_path):
    (tmp_path / "cpe.json").write_text(json.dumps({"Curl": ["haxx", "CURL"], "short": ["x"]}))
    (tmp_path / "map.json").write_text(json.dumps({"mappings": [{"rpm_name": "HTTPD", "proposed_names": ["http_server"], "confidence": "high"}, {"rpm_name": "x", "proposed_names": ["y"], "confidence": "low"}]}))
    (tmp_path / "plain.json").write_text(json.dumps({"A": ["B", "c"]}))
    (tmp_path / "desc.json").write_text(json.dumps({"A": "text"}))
    assert [tuple(r) for r in readers.read_cpe_index(spark, str(tmp_path / "cpe.json")).collect()] == [("curl", "haxx", "curl")]
    assert [tuple(r) for r in readers.read_name_mappings(spark, str(tmp_path / "map.json")).collect()] == [("httpd", "http_server")]
    assert sorted(tuple(r) for r in readers.read_name_mappings(spark, str(tmp_path / "plain.json")).collect()) == [("a", "b"), ("a", "c")]
    assert readers.read_source(spark, "descriptions", str(tmp_path / "desc.json")).first()["name"] == "A"


def test_namespace_and_logs(spark, tmp_path):
    repos = spark.createDataFrame([("org/a",), ("organic/b",)], "repository string")
    assert readers.filter_namespace(repos, "org").count() == 1
    spark.createDataFrame([(1, "i", True)], "probe_id long, image string, success boolean").write.parquet(f"{tmp_path}/p")
    assert readers.read_probe_log(spark, f"{tmp_path}/p").first()["image"] == "i" and readers.read_probe_log(spark, f"{tmp_path}/p", streaming=True).isStreaming


def test_sinks(spark, tmp_path):
    adv = spark.createDataFrame(
        [("p", "C1", "affected", "high", "1", "1-1", "2", "", "", "n"), ("p", "C1", "fixed", "high", "1", "1-1", "2", "", "", "n"), ("q", "C2", "detected", "low", "1", "1", "", "", "", "")],
        "source_package string, vuln_id string, status string, confidence string, upstream_version string, rpm_version string, upstream_fixed_version string, distro_fixed_version string, cvss_score string, notes string",
    )
    sinks.write_osv_feed(adv, f"{tmp_path}/feed", "ADV-", "Some Linux", "pkg:rpm/some/")
    assert [json.loads(r[0])["database_specific"]["status"] for r in spark.read.text(f"{tmp_path}/feed").collect()] == ["affected"]
    sinks.write_package_advisories(adv, f"{tmp_path}/docs")
    assert spark.read.json(f"{tmp_path}/docs").count() == 2
    sinks.write_bronze(spark.createDataFrame([("nvd", "x")], "source string, content string"), f"{tmp_path}/bronze")
    assert spark.read.parquet(f"{tmp_path}/bronze").first()["source"] == "nvd"


def test_yaml_rows_never_fail(spark):
    df = spark.createDataFrame([("{}",), ("id: X-1",)], "content string")
    assert readers.decode_json_or_yaml(df).count() == 2
