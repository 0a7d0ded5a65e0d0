"""Advisory records to the two normal tables, as column expressions over parsed JSON.

Every ``normalize_*`` takes rows with ``content`` (JSON text) and returns (vulnerabilities, affected):

* vulnerabilities: id, aliases, summary, details, severity, published, modified, withdrawn, refs, database_specific;
* affected: vuln_id, source, vendor, ecosystem, package_name, purl, ranges, versions, database_specific, flags.

Rows that don't parse or have no id are left out here; :func:`split_rejects` keeps them with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplylens.functions import append_unique, cpe_parts, cwe_list, ecosystem_from_url, parse_time, reference_type, truncate_ellipsis
from supplylens.sources import schemas as S

STRINGS = "array<string>"
SEVERITY = "array<struct<type:string,score:string,vector:string>>"
REFS = "array<struct<type:string,url:string>>"
AFFECTED = ["vuln_id", "source", "vendor", "ecosystem", "package_name", "purl", "ranges", "versions", "database_specific", "flags"]


def _t(c) -> Column:
    return F.coalesce(c, F.lit(""))


def _list(c, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _range(introduced="", fixed="", last="", exclusive=False, kind="") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, (str, bool)) else x
    return F.struct(
        _t(lit(kind)).alias("range_type"), _t(lit(introduced)).alias("introduced"), lit(exclusive).alias("introduced_exclusive"), _t(lit(fixed)).alias("fixed"), _t(lit(last)).alias("last_affected")
    )


def _parsed(df: DataFrame, schema: str, ident) -> DataFrame:
    rows = df.withColumn("r", F.from_json("content", schema)).withColumn("vuln_id", ident)
    return rows.filter(_t(F.col("vuln_id")) != "")


def _vulnerability(rows: DataFrame, **cols) -> DataFrame:
    none = F.lit(None)
    out = {
        "id": F.col("vuln_id"),
        "aliases": F.array().cast(STRINGS),
        "summary": F.lit(""),
        "details": F.lit(""),
        "severity": F.array().cast(SEVERITY),
        "published": none.cast("timestamp"),
        "modified": none.cast("timestamp"),
        "withdrawn": none.cast("timestamp"),
        "refs": F.array().cast(REFS),
        "database_specific": none.cast("string"),
    } | cols
    return rows.select(*[c.alias(n) for n, c in out.items()])


def split_rejects(df: DataFrame, schema: str, ident: str, sources: list[str], trees: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, rejects with ``reason``): unknown source, malformed record, missing id or a CPE tree that is too deep never fail a run.

    ``ident`` and ``trees`` (the configurations) are paths within the record.
    """
    rows = df.withColumn("__r", F.from_json("content", schema))
    missing = _t(F.expr(f"__r.{ident}")) == ""
    valid = F.try_parse_json("content").isNotNull()
    reason = F.when(~F.col("source").isin(*sources), "unknown source").when(~F.coalesce(valid, F.lit(False)), "malformed record").when(missing, "missing id")
    if trees:
        reason = reason.when(tree_too_deep(F.expr(f"__r.{trees}")), "configuration tree too deep")
    rows = rows.withColumn("reason", reason).drop("__r")
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null")


def _lower_trees(nodes, depth: int = S.NODE_DEPTH) -> Column:
    """What lies below the levels that are parsed at once, as texts."""
    if depth == 0:
        return F.flatten(F.transform(nodes, lambda n: _list(n["children"], STRINGS)))
    return F.flatten(F.transform(nodes, lambda n: _lower_trees(_list(n["children"], f"array<{S.cpe_node(depth - 1)}>"), depth - 1)))


def _roots(configurations) -> Column:
    return F.flatten(F.transform(configurations, lambda c: _list(c["nodes"], f"array<{S.cpe_node(S.NODE_DEPTH)}>")))


def _parsed_trees(texts) -> Column:
    return F.transform(texts, lambda t: F.from_json(t, S.cpe_node(S.NODE_DEPTH)))


def tree_too_deep(configurations) -> Column:
    """Whether CPE nodes lie below the levels that are read: ``NODE_DEPTH`` + 1 in each of ``NODE_ROUNDS`` rounds."""

    def deeper(texts, rounds: int) -> Column:
        return F.size(texts) > 0 if rounds == 0 else (F.size(texts) > 0) & deeper(_lower_trees(_parsed_trees(texts)), rounds - 1)

    return F.coalesce(deeper(_lower_trees(_roots(configurations)), S.NODE_ROUNDS - 1), F.lit(False))


# CVE v5


def _v5_severity(metrics) -> Column:
    pick = F.transform(_list(metrics, f"array<{S.METRIC_V5}>"), lambda m: F.coalesce(m["cvssV3_1"], m["cvssV3_0"], m["cvssV4_0"]))
    return F.transform(
        F.filter(pick, lambda c: c.isNotNull()),
        lambda c: F.struct(
            F.concat(F.lit("CVSS_V"), F.replace(_t(c["version"]), F.lit("."), F.lit("_"))).alias("type"),
            F.format_string("%.1f", F.coalesce(c["baseScore"], F.lit(0.0))).alias("score"),
            _t(c["vectorString"]).alias("vector"),
        ),
    )


def v5_explicit_ranges(versions) -> Column:
    """Ranges of the affected entries: up to ``lessThan``, else through ``lessThanOrEqual``, else open."""
    yes = F.filter(versions, lambda v: v["status"] == "affected")
    return F.transform(
        yes, lambda v: _range(v["version"], F.when(_t(v["lessThan"]) != "", v["lessThan"]), F.when(_t(v["lessThan"]) == "", v["lessThanOrEqual"]), kind=v["versionType"])
    )


def v5_default_affected_ranges(versions) -> Column:
    """Ranges where everything is affected by default: affected entries open ranges and unaffected ones with a bound close them.

    Without openings every bound closes a range from 0. Else an opening takes the first fix on its branch; openings without
    one come last and stay open.
    """
    opens = F.filter(versions, lambda v: v["status"] == "affected")
    fixes = F.filter(versions, lambda v: (v["status"] == "unaffected") & ((_t(v["lessThan"]) != "") | (_t(v["lessThanOrEqual"]) != "")))
    from_zero = F.transform(fixes, lambda f: _range("0", F.when(_t(f["lessThan"]) != "", f["lessThan"]).otherwise(f["lessThanOrEqual"]), kind=f["versionType"]))

    def fix_of(o):
        branch = F.concat(_t(o["version"]), F.lit("."))

        def closes(f):
            bound = F.when(_t(f["lessThanOrEqual"]) != "", f["lessThanOrEqual"]).otherwise(_t(f["lessThan"]))
            return F.startswith(bound, branch) | F.startswith(_t(f["version"]), branch) | (_t(f["version"]) == _t(o["version"]))

        return F.get(F.filter(fixes, closes), F.lit(0))

    paired = F.transform(opens, lambda o: F.struct(o["version"].alias("version"), fix_of(o).alias("fix")))
    closed = F.transform(
        F.filter(paired, lambda p: p["fix"].isNotNull()),
        lambda p: _range(p["version"], F.when(_t(p["fix"]["lessThanOrEqual"]) != "", p["fix"]["version"]).otherwise(p["fix"]["lessThan"]), kind=p["fix"]["versionType"]),
    )
    left = F.transform(F.filter(paired, lambda p: p["fix"].isNull()), lambda p: _range(p["version"]))
    return F.when((F.size(opens) == 0) & (F.size(fixes) > 0), from_zero).otherwise(F.concat(closed, left))


def cve_v5_affected(rows: DataFrame) -> DataFrame:
    """Affected entries of the CNA (source empty) and of each ADP (source its short name, else its title)."""
    entry = lambda c, source: F.transform(_list(c["affected"], f"array<{S.AFFECTED_V5}>"), lambda a: F.struct(source.alias("source"), a.alias("a")))
    adp = _list(F.col("r.containers.adp"), f"array<{S.CONTAINER_V5}>")
    named = lambda c: F.coalesce(F.nullif(c["providerMetadata"]["shortName"], F.lit("")), _t(c["title"]))
    every = F.concat(entry(F.col("r.containers.cna"), F.lit("")), F.flatten(F.transform(adp, lambda c: entry(c, named(c)))))
    out = rows.withColumn("e", F.explode(every)).withColumn("a", F.col("e.a")).withColumn("versions_in", _list(F.col("a.versions"), f"array<{S.VERSION_V5}>"))
    default = _t(F.col("a.defaultStatus")) == "affected"
    ranges = F.when(default, v5_default_affected_ranges(F.col("versions_in"))).otherwise(v5_explicit_ranges(F.col("versions_in")))
    out = out.withColumn("ranges", ranges)
    zero_only = default & ~F.exists("versions_in", lambda v: v["status"] == "affected")
    open_ = F.exists("ranges", lambda r: (r["fixed"] == "") & (r["last_affected"] == "")) & ~zero_only
    empty = F.size("versions_in") == 0
    flags = F.array(F.when(open_, "no_upper_bound"), F.when(empty, "empty_range"), F.when(empty & default, "unbounded_range"))
    return out.select(
        "vuln_id",
        F.col("e.source").alias("source"),
        _t(F.col("a.vendor")).alias("vendor"),
        ecosystem_from_url(_t(F.col("a.collectionURL"))).alias("ecosystem"),
        F.coalesce(F.nullif(F.col("a.packageName"), F.lit("")), _t(F.col("a.product"))).alias("package_name"),
        F.lit("").alias("purl"),
        "ranges",
        F.array().cast(STRINGS).alias("versions"),
        F.when(F.size(_list(F.col("a.cpes"), STRINGS)) > 0, F.to_json(F.struct(F.col("a.cpes").alias("cpes")))).alias("database_specific"),
        F.filter(flags, lambda f: f.isNotNull()).alias("flags"),
    )


def normalize_cve_v5(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CVE v5 records. Rejected ones keep only id and times: withdrawn and modified at their update."""
    rows = _parsed(df, S.CVE_V5, F.col("r.cveMetadata.cveId"))
    rejected = _t(F.col("r.cveMetadata.state")) == "REJECTED"
    updated = parse_time(F.col("r.cveMetadata.dateUpdated"))
    dead = _vulnerability(rows.filter(rejected), modified=updated, withdrawn=updated)
    live = rows.filter(~rejected)
    cna = F.col("r.containers.cna")
    told = F.get(F.filter(_list(cna["descriptions"], "array<struct<lang:string,value:string>>"), lambda d: (d["lang"] == "en") | d["lang"].startswith("en-")), F.lit(0))["value"]
    adp = _list(F.col("r.containers.adp"), f"array<{S.CONTAINER_V5}>")
    refs = F.transform(_list(cna["references"], "array<struct<url:string,name:string,tags:array<string>>>"), lambda r: F.struct(reference_type(r["tags"]).alias("type"), _t(r["url"]).alias("url")))
    good = _vulnerability(
        live,
        summary=F.coalesce(F.nullif(cna["title"], F.lit("")), truncate_ellipsis(told, 256), F.lit("")),
        details=_t(told),
        severity=F.concat(_v5_severity(cna["metrics"]), F.flatten(F.transform(adp, lambda c: _v5_severity(c["metrics"])))),
        published=parse_time(F.col("r.cveMetadata.datePublished")),
        modified=updated,
        refs=refs,
    )
    return dead.unionByName(good), cve_v5_affected(live)


# NVD


def _nvd_severity(m) -> Column:
    shown = lambda kind, c: F.struct(kind.alias("type"), F.format_string("%.1f", F.coalesce(c["baseScore"], F.lit(0.0))).alias("score"), _t(c["vectorString"]).alias("vector"))
    new = lambda name: F.transform(
        _list(m[name], f"array<{S.METRIC_NVD}>"), lambda w: shown(F.concat(F.lit("CVSS_V"), F.replace(_t(w["cvssData"]["version"]), F.lit("."), F.lit("_"))), w["cvssData"])
    )
    old = F.transform(_list(m["cvssMetricV2"], f"array<{S.METRIC_NVD_V2}>"), lambda w: shown(F.lit("CVSS_V2_0"), F.coalesce(w["cvssV2"], w["cvssData"])))
    return F.concat(new("cvssMetricV31"), new("cvssMetricV40"), new("cvssMetricV30"), old)


def _node_matches(node, depth: int) -> Column:
    """All CPE matches of a node, its own before its children's."""
    own = _list(node["cpeMatch"], f"array<{S.CPE_MATCH}>")
    if depth == 0:
        return own
    below = F.flatten(F.transform(_list(node["children"], f"array<{S.cpe_node(depth - 1)}>"), lambda c: _node_matches(c, depth - 1)))
    return F.concat(own, below)


def _tree_matches(nodes, rounds: int) -> Column:
    """All CPE matches of trees, round by round of parsed levels; a later round is only worked out where there is something left for it."""
    own = F.flatten(F.transform(nodes, lambda n: _node_matches(n, S.NODE_DEPTH)))
    if rounds == 1:
        return own
    none = F.array().cast(f"array<{S.CPE_MATCH}>")
    lower = F.transform(F.array(_lower_trees(nodes)), lambda texts: F.when(F.size(texts) > 0, _tree_matches(_parsed_trees(texts), rounds - 1)).otherwise(none))
    return F.concat(own, F.flatten(lower))


def nvd_affected(rows: DataFrame, configurations, source: str) -> DataFrame:
    """One affected row for each vulnerable CPE match of the configuration trees, whose levels are read as :func:`tree_too_deep` says."""
    matches = F.filter(_tree_matches(_roots(configurations), S.NODE_ROUNDS), lambda m: m["vulnerable"])
    out = rows.withColumn("m", F.explode(matches)).withColumn("cpe", cpe_parts("m.criteria"))
    start = F.coalesce(F.nullif(F.col("m.versionStartIncluding"), F.lit("")), F.nullif(F.col("m.versionStartExcluding"), F.lit("")))
    exclusive = (_t(F.col("m.versionStartIncluding")) == "") & (_t(F.col("m.versionStartExcluding")) != "")
    fixed = F.nullif(F.col("m.versionEndExcluding"), F.lit(""))
    last = F.when(fixed.isNull(), F.nullif(F.col("m.versionEndIncluding"), F.lit("")))
    free = start.isNull() & fixed.isNull() & last.isNull()
    exact = free & ~F.col("cpe.version").isin("", "*")
    ranges = F.when(exact, F.array().cast(f"array<{S.RANGE}>")).when(free, F.array(_range("0", "*"))).otherwise(F.array(_range(start, fixed, last, exclusive)))
    return out.select(
        "vuln_id",
        F.lit(source).alias("source"),
        F.col("cpe.vendor").alias("vendor"),
        F.lit("").alias("ecosystem"),
        F.col("cpe.product").alias("package_name"),
        F.lit("").alias("purl"),
        ranges.alias("ranges"),
        F.when(exact, F.array("cpe.version")).otherwise(F.array().cast(STRINGS)).alias("versions"),
        F.to_json(F.struct(F.col("m.criteria").alias("cpe"))).alias("database_specific"),
        F.filter(F.array(F.when(free & ~exact, "all_versions_affected"), F.when(~free & fixed.isNull() & last.isNull(), "no_upper_bound")), lambda f: f.isNotNull()).alias("flags"),
    )


def normalize_nvd(df: DataFrame, source: str = "nvd") -> tuple[DataFrame, DataFrame]:
    """NVD records; rejected ones keep id and times only, withdrawn at their last change."""
    rows = _parsed(df, S.NVD, F.col("r.id"))
    rejected = _t(F.col("r.vulnStatus")) == "Rejected"
    modified, published = parse_time(F.col("r.lastModified")), parse_time(F.col("r.published"))
    dead = _vulnerability(rows.filter(rejected), published=published, modified=modified, withdrawn=modified)
    live = rows.filter(~rejected)
    told = F.get(F.filter(_list(F.col("r.descriptions"), "array<struct<lang:string,value:string>>"), lambda d: d["lang"] == "en"), F.lit(0))["value"]
    cwes = _list(cwe_list("r.weaknesses"), STRINGS)
    good = _vulnerability(
        live,
        summary=_t(truncate_ellipsis(told, 256)),
        details=_t(told),
        severity=_nvd_severity(F.col("r.metrics")),
        published=published,
        modified=modified,
        refs=F.transform(
            _list(F.col("r.references"), "array<struct<url:string,source:string,tags:array<string>>>"), lambda r: F.struct(reference_type(r["tags"], "nvd").alias("type"), _t(r["url"]).alias("url"))
        ),
        database_specific=F.when(F.size(cwes) > 0, F.to_json(F.struct(cwes.alias("cwes")))),
    )
    return dead.unionByName(good), nvd_affected(live, F.col("r.configurations"), source)


def normalize_nvd_override(df: DataFrame, source: str = "nvd-overrides") -> tuple[DataFrame, DataFrame]:
    """Override records; their publication time is never copied."""
    rows = _parsed(df, S.NVD_OVERRIDE, F.col("r._annotation.cve_id"))
    note = F.col("r._annotation")
    good = _vulnerability(
        rows,
        summary=_t(truncate_ellipsis(note["description"], 256)),
        details=_t(note["description"]),
        modified=parse_time(note["modified"]),
        refs=F.transform(_list(note["references"], STRINGS), lambda u: F.struct(F.lit("WEB").alias("type"), u.alias("url"))),
    )
    return good, nvd_affected(rows, F.col("r.cve.configurations"), source)


# OSV


def osv_ranges(rng) -> Column:
    """struct<ranges, flags> of one range's events, folded in order: an introduction closes the open range, fix, limit and last affected bound it."""
    empty = F.struct(F.array().cast(f"array<{S.RANGE}>").alias("ranges"), F.array().cast(STRINGS).alias("flags"), F.lit(None).cast(S.RANGE).alias("open"))

    def close(acc):
        unbounded = (acc["open"]["fixed"] == "") & (acc["open"]["last_affected"] == "")
        known = acc["open"].isNotNull() & (acc["open"]["introduced"] != "")
        return (
            F.when(known, F.concat(acc["ranges"], F.array(acc["open"]))).otherwise(acc["ranges"]),
            F.when(known & unbounded, append_unique(acc["flags"], F.array(F.lit("no_upper_bound")))).otherwise(acc["flags"]),
        )

    def step(acc, e):
        ranges, flags = close(acc)
        opened = F.struct(
            ranges.alias("ranges"),
            F.when(e["introduced"] == "0", append_unique(flags, F.array(F.lit("unbounded_range")))).otherwise(flags).alias("flags"),
            _range(e["introduced"], kind=rng["type"]).alias("open"),
        )
        at = acc["open"]
        bound = lambda fixed, last: F.struct(
            acc["ranges"].alias("ranges"), acc["flags"].alias("flags"), _range(at["introduced"], fixed, last, kind=at["range_type"]).alias("open")
        )
        return (
            F.when(_t(e["introduced"]) != "", opened)
            .when(_t(e["fixed"]) != "", bound(e["fixed"], at["last_affected"]))
            .when(_t(e["limit"]) != "", bound(e["limit"], at["last_affected"]))
            .when(_t(e["last_affected"]) != "", bound(at["fixed"], e["last_affected"]))
            .otherwise(acc)
        )

    def finish(acc):
        ranges, flags = close(acc)
        return F.struct(ranges.alias("ranges"), flags.alias("flags"))

    return F.aggregate(_list(rng["events"], f"array<{S.OSV_EVENT}>"), empty, step, finish)


def merge_db_spec(a, b) -> Column:
    """``database_specific`` JSON with the ecosystem's part inside it: four cases, by which of them are there and whether the first is an object."""
    a, b = F.nullif(a, F.lit("null")), F.nullif(b, F.lit("null"))
    inside = F.concat(F.regexp_replace(a, r"\}\s*$", ""), F.when(a.rlike(r"^\s*\{\s*\}\s*$"), "").otherwise(","), F.lit('"ecosystem_specific":'), b, F.lit("}"))
    beside = F.concat(F.lit('{"database_specific":'), a, F.lit(',"ecosystem_specific":'), b, F.lit("}"))
    alone = F.concat(F.lit('{"ecosystem_specific":'), b, F.lit("}"))
    return F.when(b.isNull(), a).when(a.isNull(), alone).when(a.rlike(r"^\s*\{"), inside).otherwise(beside)


def normalize_osv(df: DataFrame, source: str = "osv") -> tuple[DataFrame, DataFrame]:
    """OSV records; a score that starts with ``CVSS:`` is a vector."""
    rows = _parsed(df, S.OSV, F.col("r.id"))
    severity = F.transform(
        _list(F.col("r.severity"), "array<struct<type:string,score:string>>"),
        lambda s: F.struct(_t(s["type"]).alias("type"), F.when(s["score"].startswith("CVSS:"), "").otherwise(_t(s["score"])).alias("score"), F.when(s["score"].startswith("CVSS:"), s["score"]).otherwise("").alias("vector")),
    )
    good = _vulnerability(
        rows,
        aliases=_list(F.col("r.aliases"), STRINGS),
        summary=_t(F.col("r.summary")),
        details=_t(F.col("r.details")),
        severity=severity,
        published=parse_time(F.col("r.published")),
        modified=parse_time(F.col("r.modified")),
        withdrawn=parse_time(F.col("r.withdrawn")),
        refs=F.transform(_list(F.col("r.references"), REFS), lambda r: F.struct(_t(r["type"]).alias("type"), _t(r["url"]).alias("url"))),
        database_specific=F.col("r.database_specific"),
    )
    out = rows.withColumn("a", F.explode("r.affected"))
    folded = F.transform(_list(F.col("a.ranges"), f"array<struct<type:string,events:array<{S.OSV_EVENT}>>>"), osv_ranges)
    out = out.withColumn("folded", folded).withColumn("ranges", F.flatten(F.transform("folded", lambda f: f["ranges"]))).withColumn("versions", _list(F.col("a.versions"), STRINGS))
    flags = F.array_distinct(F.flatten(F.transform("folded", lambda f: f["flags"])))
    nothing = (F.size("ranges") == 0) & (F.size("versions") == 0)
    affected = out.select(
        "vuln_id",
        F.lit(source).alias("source"),
        F.lit("").alias("vendor"),
        _t(F.col("a.package.ecosystem")).alias("ecosystem"),
        _t(F.col("a.package.name")).alias("package_name"),
        _t(F.col("a.package.purl")).alias("purl"),
        "ranges",
        "versions",
        merge_db_spec(F.col("a.database_specific"), F.col("a.ecosystem_specific")).alias("database_specific"),
        F.when(nothing, append_unique(flags, F.array(F.lit("empty_range")))).otherwise(flags).alias("flags"),
    )
    return good, affected


# Enrichment feeds


def normalize_kev(df: DataFrame) -> DataFrame:
    """KEV catalogue rows (``vulnerabilities`` array) to one row for each CVE."""
    rows = df.select(F.explode("vulnerabilities").alias("e")).filter("e.cveID != ''")
    date = lambda c: F.to_date(parse_time(c))
    return rows.select(
        F.col("e.cveID").alias("cve_id"), F.col("e.vendorProject").alias("vendor_project"), F.col("e.product").alias("product"), date("e.dateAdded").alias("date_added"),
        date("e.dueDate").alias("due_date"), F.col("e.shortDescription").alias("short_description"), F.col("e.requiredAction").alias("required_action"), F.col("e.notes").alias("notes"),
    )


def normalize_epss(df: DataFrame) -> DataFrame:
    """EPSS batches in ``content`` to one row for each CVE, with the batch's model version and date."""
    rows = df.withColumn("r", F.from_json("content", S.EPSS))
    rows = rows.select(F.explode("r.scores").alias("s"), F.col("r.model_version").alias("model_version"), F.to_date(parse_time("r.score_date")).alias("score_date"))
    return rows.select(F.col("s.cve").alias("cve_id"), F.col("s.epss").cast("float").alias("score"), F.col("s.percentile").cast("float").alias("percentile"), "model_version", "score_date")


# Line forms of the Debian tracker's list.
DEBIAN_FORMS = {
    "head": r"^(CVE-\d{4}-\d+)\s*(.*)",
    "note": r"^\s+NOTE:\s*(.+)",
    "advisory": r"^\s+\{((?:DSA|DLA)-\d+-\d+)\}",
    "release": r"^\s+\[(\S+)\]\s+-\s+(\S+)\s+(.*)",
    "package": r"^\s+-\s+(\S+)\s+(.*)",
    "tag": r"<([^>]+)>",
}


def normalize_debian_notes(lines: DataFrame) -> DataFrame:
    """(cve_id, vendor, description, notes, advisories, packages) from the lines (file, pos, line) of a tracker list.

    A ``CVE-`` line opens a group and a line that isn't indented ends it. Of a line's readings the first holds: NOTE, advisory in braces, package in a
    release, package. A CVE listed twice keeps its last group. One file is one ordered document and is read as one window.
    """
    w = Window.partitionBy("file").orderBy("pos")
    part = lambda form, i: F.regexp_extract("line", DEBIAN_FORMS[form], i)
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"^\(", ""), r"\)$", "")
    head = part("head", 1)
    indented = F.col("line").startswith("\t") | F.col("line").startswith("  ")
    rows = lines.withColumn("head", F.nullif(head, F.lit(""))).withColumn("edge", F.col("head").isNotNull() | ~indented)
    rows = rows.withColumn("group", F.sum(F.col("edge").cast("int")).over(w))
    note = F.nullif(F.trim(part("note", 1)), F.lit(""))
    advisory = F.nullif(part("advisory", 1), F.lit(""))
    release = part("release", 1)
    name = F.when(release != "", part("release", 2)).otherwise(part("package", 1))
    rest = F.trim(F.when(release != "", part("release", 3)).otherwise(part("package", 2)))
    tag = F.regexp_extract(rest, DEBIAN_FORMS["tag"], 1)
    told = bare(F.regexp_replace(rest, DEBIAN_FORMS["tag"], ""))
    package = F.struct(
        F.col("pos"), name.alias("package"), F.when(release != "", release).otherwise("unstable").alias("release"), F.when(tag == "", rest).otherwise("").alias("version"),
        F.when(tag == "", "fixed").otherwise(tag).alias("status"), F.when(tag == "", "").otherwise(told).alias("note"),
    )
    body = indented & F.col("head").isNull()
    described = bare(part("head", 2))
    rows = rows.select(
        "file", "group", "pos", "head",
        F.when(F.col("head").isNotNull(), described).alias("description"),
        F.when(body, note).alias("note"),
        F.when(body & note.isNull(), advisory).alias("advisory"),
        F.when(body & note.isNull() & advisory.isNull() & (name != ""), package).alias("package"),
    )
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("x"))))), lambda s: s["x"])
    groups = rows.groupBy("file", "group").agg(
        F.first("head", ignorenulls=True).alias("cve_id"), F.first("description", ignorenulls=True).alias("description"), ordered("note").alias("notes"),
        ordered("advisory").alias("advisories"), F.sort_array(F.collect_list("package")).alias("packages"), F.min("pos").alias("at"),
    )
    last = Window.partitionBy("cve_id").orderBy(F.desc("file"), F.desc("at"))
    groups = groups.filter("cve_id is not null").withColumn("n", F.row_number().over(last)).filter("n = 1")
    return groups.select("cve_id", F.lit("debian").alias("vendor"), "description", "notes", "advisories", "packages")


# Catalogue


def sbom_packages(df: DataFrame) -> DataFrame:
    """(platform_id, name, version, type, purl) from SPDX documents in ``content``; without a purl one is made of type, name and version."""
    rows = df.withColumn("r", F.from_json("content", S.SBOM)).select("platform_id", F.explode("r.packages").alias("p"))
    refs = F.filter(_list(F.col("p.externalRefs"), "array<struct<referenceCategory:string,referenceType:string,referenceLocator:string>>"), lambda x: x["referenceType"] == "purl")
    purl = F.nullif(F.get(refs, F.lit(0))["referenceLocator"], F.lit(""))
    rows = rows.select("platform_id", _t(F.col("p.name")).alias("name"), _t(F.col("p.versionInfo")).alias("version"), purl.alias("given"))
    kind = F.when(F.col("given").isNotNull(), F.regexp_extract("given", "^pkg:([^/]+)/", 1)).otherwise("unknown")
    rows = rows.withColumn("type", kind)
    return rows.select("platform_id", "name", "version", "type", F.coalesce("given", F.format_string("pkg:%s/%s@%s", "type", "name", "version")).alias("purl"))


def platform_config(df: DataFrame) -> DataFrame:
    """Layer count and size, labels (the image's, else the configuration's), sorted ports and creation time from ``content``."""
    rows = df.withColumn("r", F.from_json("content", S.IMAGE_CONFIG))
    layers = _list(F.col("r.layers"), "array<struct<size:bigint>>")
    return rows.select(
        "platform_id",
        F.size(layers).alias("layer_count"),
        F.aggregate(layers, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["size"], F.lit(0))).alias("compressed_size"),
        F.coalesce("r.labels", "r.config.Labels").alias("labels"),
        F.sort_array(_list(F.map_keys("r.config.ExposedPorts"), STRINGS)).alias("exposed_ports"),
        parse_time("r.created").alias("created_at"),
    )


def platforms_from_manifest(df: DataFrame) -> DataFrame:
    """(image_id, platform_id, os, architecture, variant); entries without a platform are skipped, an image without an index is linux/amd64 itself."""
    rows = df.withColumn("r", F.from_json("content", S.MANIFEST))
    index = rows.filter("r.manifests is not null").select("image_id", F.explode("r.manifests").alias("m")).filter("m.platform is not null")
    many = index.select("image_id", F.col("m.digest").alias("platform_id"), _t(F.col("m.platform.os")).alias("os"), _t(F.col("m.platform.architecture")).alias("architecture"), _t(F.col("m.platform.variant")).alias("variant"))
    one = rows.filter("r.manifests is null").select("image_id", F.col("image_id").alias("platform_id"), F.lit("linux").alias("os"), F.lit("amd64").alias("architecture"), F.lit("").alias("variant"))
    return many.unionByName(one)


# Review texts

ASSESSMENTS = "array<struct<cve_id:string,status:string,confidence:string,reasoning:string>>"


def parse_assessments(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add cve_id, status, confidence and reasoning, a row for each assessment in a reviewer's answer.

    Code fences are taken off, but those inside a text stay; of a list that doesn't parse everything to the last complete object is kept. Unknown statuses become ``under-review``, unknown confidences ``low``.
    """
    raw = F.coalesce(text_col, F.lit(""))
    tail = F.substr(raw, F.instr(raw, "["))
    bare = lambda c: F.regexp_replace(c, r"```(?:json)?\s*\n?", "")
    # Strings lie between an odd quote and the next; escaped backslashes and quotes are control characters meanwhile, which JSON doesn't have in strings.
    parts = F.split(F.replace(F.replace(tail, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02")), '"')
    outside = lambda f, g: F.array_join(F.transform("__parts", lambda x, i: F.when(i % 2 == 1, g(x)).otherwise(f(x))), '"')
    rows = df.filter(F.instr(raw, "[") > 0).withColumn("__all", bare(tail)).withColumn("__parts", parts)
    shown = lambda c: F.replace(F.replace(c, F.lit("\x01"), F.lit("\\\\")), F.lit("\x02"), F.lit('\\"'))
    rows = rows.withColumn("__t", outside(lambda x: shown(bare(x)), shown)).withColumn("__seen", outside(lambda x: shown(bare(x)), lambda x: F.repeat(F.lit(" "), F.char_length(shown(x)))))
    upto = lambda t, c, seen: F.when(F.instr(seen, c) > 0, F.substr(t, F.lit(1), F.char_length(seen) - F.instr(F.reverse(seen), c) + 1))
    whole = lambda t: upto(F.col(t), "]", F.col(t))
    saved = lambda t, seen: F.concat(upto(F.col(t), "}", F.col(seen)), F.lit("]"))
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    found = F.coalesce(*map(valid, (whole("__t"), saved("__t", "__t"), saved("__t", "__seen"), whole("__all"), saved("__all", "__all"))))
    rows = rows.withColumn("__items", F.from_json(found, ASSESSMENTS)).withColumn("__i", F.explode("__items"))
    rows = rows.filter("__i is not null")
    pick = lambda c, allowed, other: F.when(c.isin(*allowed), c).otherwise(other)
    return rows.withColumns(
        {
            "cve_id": _t(F.col("__i.cve_id")),
            "status": pick(F.col("__i.status"), ("affected", "not-affected", "under-review"), "under-review"),
            "confidence": pick(F.col("__i.confidence"), ("high", "medium", "low"), "low"),
            "reasoning": _t(F.col("__i.reasoning")),
        }
    ).drop("__all", "__parts", "__t", "__seen", "__items", "__i")


# Ways in which reviewers state a name mapping.
MAPPING_PATTERNS = (
    r"(?i)(?:RPM|package)\s+['\"]?(\w[\w.-]*)['\"]?\s+(?:maps?|corresponds?|equals?)\s+(?:to\s+)?(?:upstream\s+)?['\"]?(\w[\w.-]*)['\"]?",
    r"(?i)['\"]?(\w[\w.-]*)['\"]?\s+(?:in\s+)?(?:NVD|CPE|vuln)\s+(?:is|=)\s+['\"]?(\w[\w.-]*)['\"]?",
)


def extract_mapping_proposals(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add rpm_name and vuln_name for each mapping that a text proposes; names mapped to themselves are left out."""
    found = lambda p: F.arrays_zip(F.regexp_extract_all(text_col, F.lit(p), F.lit(1)).alias("rpm"), F.regexp_extract_all(text_col, F.lit(p), F.lit(2)).alias("vuln"))
    rows = df.withColumn("__m", F.explode(F.concat(*[found(p) for p in MAPPING_PATTERNS])))
    rows = rows.withColumn("rpm_name", F.lower("__m.rpm")).withColumn("vuln_name", F.lower("__m.vuln")).drop("__m")
    return rows.filter("rpm_name != vuln_name")


# Dispatch

# Record sources and their formats.
NORMALIZERS = {
    "cvelistv5": normalize_cve_v5,
    "nvd": normalize_nvd,
    "anchore-nvd-overrides": normalize_nvd_override,
    "osv": normalize_osv,
    "ghsa": normalize_osv,
    "govuln": normalize_osv,
    "kernel": normalize_osv,
    "psf": normalize_osv,
    "pypa": normalize_osv,
    "rustsec": normalize_osv,
}


#: Schema, path of the id and path of the CPE trees of each format.
FORMATS = {
    normalize_cve_v5: (S.CVE_V5, "cveMetadata.cveId", None),
    normalize_nvd: (S.NVD, "id", "configurations"),
    normalize_nvd_override: (S.NVD_OVERRIDE, "_annotation.cve_id", "cve.configurations"),
    normalize_osv: (S.OSV, "id", None),
}


def rejects(bronze: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """The rows of ``bronze`` that :func:`normalize` cannot take whole, with ``reason``. Sources with a normalizer of their own are only asked for JSON."""
    known = list(sources or NORMALIZERS)
    out = bronze.filter(~F.coalesce(F.col("source").isin(*known), F.lit(False))).withColumn("reason", F.lit("unknown source"))
    by_format: dict = {}
    for source in known:
        by_format.setdefault(FORMATS.get(NORMALIZERS[source]), []).append(source)
    for form, names in by_format.items():
        rows = bronze.filter(F.col("source").isin(*names))
        if form is None:
            bad = rows.filter(F.try_parse_json("content").isNull()).withColumn("reason", F.lit("malformed record"))
        else:
            bad = split_rejects(rows, form[0], form[1], names, form[2])[1]
        out = out.unionByName(bad)
    return out


def register_normalizer(source: str, fn) -> None:
    """Let ``fn`` (rows with content -> vulnerabilities, affected) read the records of a source."""
    NORMALIZERS[source] = fn


def normalize(bronze: DataFrame, sources: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables of all records of the known sources; ``affected.source`` is the record's source where the format names none."""
    v, a = None, None
    for source in sources or list(NORMALIZERS):
        part_v, part_a = NORMALIZERS[source](bronze.filter(F.col("source") == source))
        part_a = part_a.withColumn("source", F.when(F.col("source") == "", source).otherwise(F.col("source")))
        part_v = part_v.withColumn("source", F.lit(source))
        v, a = (part_v, part_a) if v is None else (v.unionByName(part_v), a.unionByName(part_a))
    return v, a
