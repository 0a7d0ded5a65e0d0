"""Scalar functions against golden rows."""

import random

import pytest
from pyspark.sql import functions as F

from supplylens import functions as fn


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()] or [F.lit(1).alias("x")])
    return row.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("a", "b", "sign"),
    [
        ("1.0", "1.0.0", 0), ("1.10", "1.9", 1), ("1.0.post1", "1.0", 1), ("1.0.dev1", "1.0a1", -1),
        ("1!1.0", "2.0", 1), ("1.0+abc", "1.0", 1), ("1.0+2", "1.0+abc", 1), ("1.0rc1", "1.0b2", 1), ("v1.0", "1.0", 0), ("1.0-1", "1.0.post1", 0), ("1.0.x", "1.0.y", -1),
        ("1.0.x", "1.0", 1), ("7.0.0-rc1", "7.0.0-rc2", -1), ("1.01", "1.1", 0), ("0", "0.0.0", 0), ("1.0a", "1.0a0", 0),
    ],
)
def test_compare_versions(spark, a, b, sign):
    assert one(spark, fn.compare_versions("a", "b"), a=a, b=b) == sign
    assert one(spark, fn.compare_versions("b", "a"), a=a, b=b) == -sign


def test_version_key_orders_numbers(spark):
    rng = random.Random(3)
    versions = [".".join(str(rng.choice([0, 1, 9, 10, 11, 100])) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in versions], "v string").select("v", fn.version_key("v").alias("k")).collect()

    def plain(v):
        parts = [int(x) for x in v.split(".")]
        while len(parts) > 1 and parts[-1] == 0:
            parts.pop()
        return parts

    ours = sorted(rows, key=lambda r: r["k"])
    assert [plain(r["v"]) for r in ours] == sorted(plain(v) for v in versions)


@pytest.mark.parametrize(("v", "ok"), [("", True), ("*", True), ("deadbeef01", False), ("2024-01-15", False), ("1.2", True), ("v1.2", False), ("20240115", False), ("123456", True)])
def test_comparable(spark, v, ok):
    assert one(spark, fn.is_comparable("v"), v=v) is ok


@pytest.mark.parametrize(
    ("s", "year"), [("2024-03-01T10:00:00Z", 2024), ("2024-03-01T10:00:00.123+02:00", 2024), ("2024-03-01T10:00:00", 2024), ("2024-03-01", 2024), ("2024-03", None), ("", None), ("junk", None), (None, None)]
)
def test_parse_time(spark, s, year):
    got = spark.createDataFrame([(s,)], "s string").select(fn.parse_time("s").alias("r")).first()["r"]
    assert (got.year if got else None) == year


def test_truncate_counts_code_points(spark):
    assert one(spark, fn.truncate_ellipsis("s", 8), s="é" * 9) == "é" * 5 + "..."
    assert one(spark, fn.truncate_ellipsis("s", 8), s="é" * 8) == "é" * 8


def test_versions_compare_as_built(spark):
    """Versions written from (epoch, release, stage, number) in several spellings compare as these tuples do."""
    rng = random.Random(12)
    stages = [("dev", ".dev", "dev"), ("a", "a", ".alpha"), ("b", "b", "-beta"), ("c", "rc", "_c"), ("", "", ""), ("post", ".post", "-r")]

    def some():
        epoch, release, rank = rng.choice([0, 0, 0, 2]), [rng.randrange(12) for _ in range(rng.randrange(1, 4))], rng.randrange(len(stages))
        number = rng.randrange(3) if stages[rank][0] else 0
        text = (f"{epoch}!" if epoch else "") + ".".join(map(str, release)) + (rng.choice(stages[rank][1:]) + str(number) if stages[rank][0] else "")
        while len(release) > 1 and not release[-1]:
            release.pop()
        return text, (epoch, release, rank, number)

    pairs = [(*some(), *some()) for _ in range(500)]
    got = spark.createDataFrame([(a, b) for a, _, b, _ in pairs], "a string, b string").select(fn.compare_versions("a", "b").alias("r")).collect()
    assert [g["r"] for g in got] == [(x > y) - (x < y) for _, x, _, y in pairs]


def test_source_packages_are_read_back(spark):
    """Purls written from a source package, version and release give these back; others fall back to the package itself."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ghk") for _ in range(3))
    rows = []
    for i in range(120):
        name, version, release = "-".join(word() for _ in range(rng.randrange(1, 4))), f"{i}.{rng.randrange(9)}", f"{rng.randrange(9)}.fc{i % 3}"
        more = rng.choice(["", "arch=noarch&", "epoch=1&distro=x&"])
        told = rng.random() < 0.6
        purl = f"pkg:rpm/x?{more}upstream={name}-{version}-{release}.src.rpm" if told else rng.choice(["pkg:rpm/x", "pkg:rpm/x?upstream=unclear", None])
        rows.append((purl, "own", f"9.{i}-{release}", name if told else "own", version if told else f"9.{i}"))
    got = spark.createDataFrame(rows, "p string, n string, v string, name string, version string").select("name", "version", fn.parse_source_rpm("p", "n", "v").alias("r")).collect()
    assert [tuple(g["r"]) for g in got] == [(g["name"], g["version"]) for g in got]


def test_name_variants_from_pieces(spark):
    """Names put together from pieces have the variants that these pieces tell."""
    rng = random.Random(9)
    rows = []
    for _ in range(150):
        lib, stem, sep, tail, digits = rng.choice(["", "lib"]), rng.choice(["hop", "kit"]), rng.choice(["", "-", "_"]), rng.choice(["x", "yz"]), rng.choice(["", "4", "12"])
        base = lib + stem + (sep + tail if sep else "")
        name = base + digits
        sure = ({base} if digits else set()) | (set() if lib else {"lib" + name}) | ({name.replace("-", "_")} if sep == "-" else {name.replace("_", "-")} if sep == "_" else set())
        rows.append((name, sorted(sure), [name[3:]] if lib else []))
    got = spark.createDataFrame(rows, "n string, sure array<string>, unsure array<string>").select("*", fn.name_variants("n").alias("v")).collect()
    for g in got:
        assert sorted(v["name"] for v in g["v"] if v["kind"] == "confident") == g["sure"], g["n"]
        assert [v["name"] for v in g["v"] if v["kind"] == "uncertain"] == g["unsure"], g["n"]


def fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) % 2**64
    return h


@pytest.mark.parametrize("key", ["", "a", "key-17", "schlüssel", "x" * 200])
def test_fnv_bucket(spark, key):
    got = one(spark, fn.fnv_bucket(F.lit(bytearray(b"q\x00\x01")), "k", 86_400), k=key)
    assert got == fnv(b"q\x00\x01" + key.encode()) % 86_400


@pytest.mark.parametrize(
    ("ref", "want"),
    [
        ("alpine", ("docker.io", "library/alpine", "")), ("alpine:3.19", ("docker.io", "library/alpine", "3.19")), ("org/app:1", ("docker.io", "org/app", "1")),
        ("quay.io/org/app@sha256:" + "a" * 64, ("quay.io", "org/app", "sha256:" + "a" * 64)), ("localhost:5000/app:x", ("localhost:5000", "app", "x")),
    ],
)
def test_image_ref(spark, ref, want):
    got = one(spark, fn.image_ref("r"), r=ref)
    assert (got["registry"], got["repository"], got["tag"]) == want


def test_keys(spark):
    assert one(spark, fn.platform_key("a", "b", "c", "d"), a="id", b="linux", c="arm64", d="v8") == "id|linux/arm64/v8"
    assert one(spark, fn.split_key("k"), k="grype|sha256:b|linux/amd64")["tail"] == "sha256:b|linux/amd64"
    assert one(spark, fn.split_key("k"), k="|x") is None
    assert one(spark, fn.split_key("k"), k="plain") is None


def test_jumps_are_more_than_two_major_versions(spark):
    rng = random.Random(2)
    rows = [(rng.choice([f"{a}", f"{a}.{b}", f"{a}.x"]), rng.choice([f"{b}", f"{b}.0.1"]), b > a + 2) for a, b in ((rng.randrange(8), rng.randrange(12)) for _ in range(80))]
    rows += [(odd, "9", False) for odd in ("", "r5", "-", None)] + [("1", odd, False) for odd in ("", "*", None)]
    got = spark.createDataFrame(rows, "v string, f string, j boolean").select("j", fn.suspicious_jump("v", "f").alias("r")).collect()
    assert [g["r"] for g in got] == [g["j"] for g in got]


def test_transitions_and_backoff(spark):
    assert one(spark, fn.is_valid_transition("a", "b"), a="pending", b="claimed") is True
    assert one(spark, fn.is_valid_transition("a", "b"), a="succeeded", b="pending") is False
    assert one(spark, fn.is_valid_transition("a", "b"), a="odd", b="pending") is False
    assert one(spark, fn.backoff_seconds("a", 10, 60), a=0) == 10
    assert one(spark, fn.backoff_seconds("a", 10, 60), a=4) == 60
    assert one(spark, fn.backoff_seconds("a", 10, 60), a=4000) == 60


def test_reference_type(spark):
    assert one(spark, fn.reference_type("t"), t=["x", "patch", "exploit"]) == "FIX"
    assert one(spark, fn.reference_type(F.lit(None).cast("array<string>"))) == "WEB"
    assert one(spark, fn.reference_type("t", "nvd"), t=["Vendor Advisory"]) == "ADVISORY"


def test_severity_rank(spark):
    assert one(spark, fn.severity_rank("s"), s="CRITICAL") == 0
    assert one(spark, fn.severity_rank(F.lit(None).cast("string"))) == 4
