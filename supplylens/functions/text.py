"""Text, time and JSON functions of the advisory formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Host of a package registry -> ecosystem, first match in this order.
ECOSYSTEM_HOSTS = {
    "npmjs.com": "npm",
    "pypi.org": "PyPI",
    "crates.io": "crates.io",
    "pkg.go.dev": "Go",
    "rubygems.org": "RubyGems",
    "repo1.maven.org": "Maven",
    "nuget.org": "NuGet",
}
# Reference tag -> reference type.
REFERENCE_TAGS = {
    "cve": {"vendor-advisory": "ADVISORY", "patch": "FIX", "exploit": "EVIDENCE"},
    "nvd": {"Vendor Advisory": "ADVISORY", "Patch": "FIX", "Exploit": "EVIDENCE"},
}
# Where a purl names its source package, and how that splits into name and version.
UPSTREAM = r"upstream=([^&]+)"
SOURCE_RPM = r"^(.+?)-(\d.*)\.src\.rpm$"
# Severities from the most urgent.
SEVERITIES = ("critical", "high", "medium", "low")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    return F.nullif(col(c), F.lit(""))


def parse_time(c) -> Column:
    """RFC 3339 times with or without fraction, zone-less times (UTC) and dates; null for anything else."""
    c = col(c)
    form = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$"
    # Fractions of a zone-less time aren't a known layout.
    odd = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+$"
    return F.when(c.rlike(form) & ~c.rlike(odd), F.try_to_timestamp(c))


def truncate_ellipsis(c, n: int) -> Column:
    """At most ``n`` code points; longer text keeps ``n - 3`` and three dots."""
    c = col(c)
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def reference_type(tags, vocabulary: str = "cve") -> Column:
    """Type of the first tag that has one, ``WEB`` otherwise (also for null and empty lists)."""
    known = lookup(REFERENCE_TAGS[vocabulary])
    return F.coalesce(F.get(F.filter(F.transform(col(tags), lambda t: known[t]), lambda t: t.isNotNull()), F.lit(0)), F.lit("WEB"))


def ecosystem_from_url(c) -> Column:
    out = F.lit("")
    for host, name in reversed(ECOSYSTEM_HOSTS.items()):
        out = F.when(F.contains(col(c), F.lit(host)), name).otherwise(out)
    return out


def cpe_parts(c) -> Column:
    """struct<vendor, product, version> of a CPE 2.3 name by plain splitting; short names give empty parts."""
    parts = F.split(col(c), ":")
    whole = F.size(parts) >= 5
    return F.struct(
        F.when(whole, F.get(parts, F.lit(3))).otherwise("").alias("vendor"),
        F.when(whole, F.get(parts, F.lit(4))).otherwise("").alias("product"),
        F.coalesce(F.get(parts, F.lit(5)), F.lit("")).alias("version"),
    )


def append_unique(a, b) -> Column:
    """Elements of both lists, each once, in order of first appearance; a null list is empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(col(a), empty), F.coalesce(col(b), empty)))


def cwe_list(weaknesses) -> Column:
    """English CWE names of array<struct<description: array<struct<lang, value>>>>, without the two that say nothing."""
    every = F.flatten(F.transform(col(weaknesses), lambda w: F.coalesce(w["description"], F.array().cast("array<struct<lang:string,value:string>>"))))
    told = F.filter(every, lambda d: (d["lang"] == "en") & ~d["value"].isin("NVD-CWE-noinfo", "NVD-CWE-Other"))
    return F.transform(told, lambda d: d["value"])


def parse_source_rpm(purl, name, version) -> Column:
    """struct<source, version> from the purl's ``upstream=`` source package, else the name and the version before its first ``-``."""
    upstream = F.regexp_extract(F.coalesce(col(purl), F.lit("")), UPSTREAM, 1)
    source = F.regexp_extract(upstream, SOURCE_RPM, 1)
    full = F.regexp_extract(upstream, SOURCE_RPM, 2)
    found = source != ""
    return F.struct(
        F.when(found, source).otherwise(col(name)).alias("source"),
        F.split_part(F.when(found, full).otherwise(col(version)), F.lit("-"), F.lit(1)).alias("version"),
    )


def strip_version_suffix(c) -> Column:
    """``python3.14`` -> ``python``: digits and dotted digits at the end go, then dots."""
    return F.rtrim(F.regexp_replace(col(c), r"\d+(\.\d+)*$", ""), F.lit("."))


def name_variants(c) -> Column:
    """Other names a package may go by: array<struct<name, kind>> with kinds confident and uncertain, distinct, of lower-case names.

    Confident: with ``lib`` in front, without trailing version digits, hyphens and underscores exchanged.
    Uncertain: without ``lib`` in front.
    """
    n = F.lower(col(c))
    made = lambda v, kind: F.struct(v.alias("name"), F.lit(kind).alias("kind"))
    cut = F.regexp_replace(n, r"\d+(\.\d+)*$", "")
    digits = F.regexp_replace(n, r"\d+$", "")
    none = F.lit(None).cast("string")
    variants = F.array(
        made(F.when(~n.startswith("lib"), F.concat(F.lit("lib"), n)).otherwise(none), "confident"),
        made(F.when((cut != "") & (cut != n), cut).otherwise(none), "confident"),
        made(F.when((cut != "") & (cut != n), F.rtrim(cut, F.lit("."))).otherwise(none), "confident"),
        made(F.when((digits != "") & (digits != n), digits).otherwise(none), "confident"),
        made(F.when(n.contains("-"), F.replace(n, F.lit("-"), F.lit("_"))).otherwise(none), "confident"),
        made(F.when(n.contains("_"), F.replace(n, F.lit("_"), F.lit("-"))).otherwise(none), "confident"),
        made(F.when(n.startswith("lib") & (F.char_length(n) > 3), F.substring(n, 4, 1 << 30)).otherwise(none), "uncertain"),
    )
    return F.array_distinct(F.filter(variants, lambda v: v["name"].isNotNull()))


def severity_rank(c) -> Column:
    """0 for critical to 3 for low, 4 for anything else, in any case."""
    known = F.create_map(*[F.lit(x) for i, s in enumerate(SEVERITIES) for x in (s, i)])
    return F.coalesce(known[F.lower(col(c))], F.lit(len(SEVERITIES)))


def icontains(c, needle) -> Column:
    """Whether ``needle`` occurs literally in the text, in any case."""
    needle = needle if isinstance(needle, Column) else F.lit(needle)
    return F.contains(F.lower(col(c)), F.lower(needle))


def cve_for_enrichment(vuln_id, aliases) -> Column:
    """The id itself if it is a CVE, else the first alias that is one, else the id."""
    first = F.get(F.filter(col(aliases), lambda a: a.startswith("CVE-")), F.lit(0))
    return F.when(col(vuln_id).startswith("CVE-"), col(vuln_id)).otherwise(F.coalesce(first, col(vuln_id)))


def json_field(c, path: str) -> Column:
    return F.get_json_object(col(c), path)
