"""Catalogue build, associations, scanners and comparators."""

import json

from pyspark.sql import functions as F

from supplylens.operators import catalog


def test_build_catalog(spark):
    manifests = spark.createDataFrame([("i1", json.dumps({"manifests": [{"digest": "d1", "platform": {"os": "linux", "architecture": "arm64", "variant": "v8"}}, {"digest": "d2"}]})), ("i2", json.dumps({"mediaType": "x"})), ("i3", "broken")], "image_id string, content string")
    tags = spark.createDataFrame([(1, "r", "latest", "i1", 1), (2, "r", "latest", "i2", 2), (3, "r", "v1.sig", "i1", 3)], "event_id int, repository string, tag string, image_id string, ts int")
    sboms = spark.createDataFrame([("d1", json.dumps({"packages": [{"name": "a", "versionInfo": "1"}, {"name": "a", "versionInfo": "1"}]})), ("gone", json.dumps({"packages": [{"name": "b"}]}))], "platform_id string, content string")
    out = catalog.build_catalog(manifests, tags, sboms)
    assert sorted((r["platform_id"], r["architecture"]) for r in out["platforms"].collect()) == [("d1", "arm64"), ("i2", "amd64"), ("i3", "amd64")]
    assert sorted((r["image_id"], r["current"]) for r in out["tags"].collect()) == [("i1", False), ("i2", True)]
    assert [r["reference"] for r in out["references"].collect()] == ["r:latest"]
    assert [tuple(r) for r in out["platform_packages"].collect()] == [("d1", "pkg:unknown/a@1")] and out["packages"].count() == 1
    grown = catalog.add_associations(spark.createDataFrame([("d1", "old")], "platform_id string, purl string"), out["platform_packages"])
    assert grown.count() == 2


def test_scanners_and_comparators(spark):
    catalog.register_scanner("none", lambda pp, p, a, v: pp.limit(0))
    assert "none" in catalog.SCANNERS
    del catalog.SCANNERS["none"]
    df = spark.createDataFrame([("1.0", "SEMVER"), ("abc123", "GIT"), ("1.0", None)], "b string, t string")
    keys = [r["k"] for r in df.select(catalog.range_key(F.col("b"), F.col("t")).alias("k")).collect()]
    assert keys[0] is not None and keys[1] is None and keys[2] is not None and keys[2] != keys[0]  # two orders
    a = spark.createDataFrame([([("GIT", "x"), ("SEMVER", "1")],)], "ranges array<struct<range_type: string, fixed: string>>")
    assert [r["fixed"] for r in catalog.drop_unordered_ranges(a).first()["ranges"]] == ["1"]
