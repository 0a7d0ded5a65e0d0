"""Registered queries: scalar functions, version ranges, name resolution, advisories and normalised records, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplylens import functions as fn
from supplylens.functions import ordering
from supplylens.operators import catalog, lookups, matching, normalize
from supplylens.plans.catalogue import Tables
from supplylens.plans.standins import expand
from supplylens.streaming import worklog

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = expand(oracle)
        return f

    return add


# Scalar functions


@query("""
SELECT o_orderkey, o_orderdate AS t_date, strptime('2024-03-0' || CAST(1 + o_orderkey % 9 AS STRING) || 'T10:00:00', '%Y-%m-%dT%H:%M:%S') AS t_plain, CAST(NULL AS TIMESTAMP) AS t_junk FROM orders
""")
def fn_parse_time(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    plain = F.concat(F.lit("2024-03-0"), (1 + F.col("o_orderkey") % 9).cast("string"), F.lit("T10:00:00Z"))
    ntz = lambda c: fn.parse_time(c).cast("timestamp_ntz")
    return o.select("o_orderkey", ntz(day).alias("t_date"), ntz(plain).alias("t_plain"), ntz(F.col("o_orderpriority")).alias("t_junk"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 37) || '...' ELSE text END AS short, substr(sha256(text), 1, 16) AS id, contains(lower(text), 'the') AS has_the FROM documents")
def fn_text(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", fn.truncate_ellipsis("text", 40).alias("short"), fn.short_id("text").alias("id"), fn.icontains("text", "THE").alias("has_the"))


@query("""
SELECT o_orderkey, 'd' || CAST(o_orderkey AS STRING) || '|linux/amd64' || CASE WHEN o_orderkey % 2 = 0 THEN '/v8' ELSE '' END AS key, 'd' || CAST(o_orderkey AS STRING) AS head,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 WHEN '4' THEN 4 ELSE 3 END AS rank, o_orderkey % 3 = 0 AS skipped, 'vendor' || CAST(o_custkey AS STRING) AS vendor, 'prod' AS product FROM orders
""")
def fn_keys(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    n = F.col("o_orderkey")
    key = fn.platform_key(F.concat(F.lit("d"), n.cast("string")), F.lit("linux"), F.lit("amd64"), F.when(n % 2 == 0, "v8").otherwise(""))
    names = F.element_at(F.array(*[F.lit(x) for x in ("CRITICAL", "High", "medium", "nothing", "low")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    tag = F.when(n % 3 == 0, F.when(n % 2 == 0, "v1.sig").otherwise("sha256-abc")).otherwise("v1.sigs")
    cpe = fn.cpe_parts(F.concat(F.lit("cpe:2.3:a:vendor"), F.col("o_custkey").cast("string"), F.lit(":prod:1.0:*")))
    return o.select("o_orderkey", key.alias("key"), fn.split_key(key)["head"].alias("head"), fn.severity_rank(names).alias("rank"), fn.is_skipped_tag(tag).alias("skipped"), cpe["vendor"].alias("vendor"), cpe["product"].alias("product"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'src_' || CAST(p_partkey AS STRING) ELSE 'bin' || CAST(p_partkey AS STRING) END AS source, CAST(p_size AS STRING) || '.4' AS version,
  CASE WHEN p_partkey % 3 = 0 THEN 'npm' WHEN p_partkey % 3 = 1 THEN 'Go' ELSE '' END AS ecosystem, p_size % 9 > p_size % 4 + 2 AS jump, p_size % 3 <> 0 AS comparable FROM part
""")
def fn_package_names(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    n, size = F.col("p_partkey").cast("string"), F.col("p_size")
    purl = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("pkg:rpm/x?arch=x86_64&upstream=src_"), n, F.lit("-"), size.cast("string"), F.lit(".4-2.el9.src.rpm"))).otherwise("pkg:rpm/x")
    s = fn.parse_source_rpm(purl, F.concat(F.lit("bin"), n), F.concat(size.cast("string"), F.lit(".4-1")))
    url = F.when(F.col("p_partkey") % 3 == 0, "https://www.npmjs.com/x").when(F.col("p_partkey") % 3 == 1, "https://pkg.go.dev/y").otherwise("https://example.org")
    jump = fn.suspicious_jump(F.concat((size % 4).cast("string"), F.lit(".1")), F.concat((size % 9).cast("string"), F.lit(".0")))
    bound = F.when(size % 3 == 0, F.when(size % 2 == 0, "2024-01-01").otherwise("deadbeef")).otherwise(F.concat(size.cast("string"), F.lit(".0rc1")))
    return p.select("p_partkey", s["source"].alias("source"), s["version"].alias("version"), fn.ecosystem_from_url(url).alias("ecosystem"), jump.alias("jump"), fn.is_comparable(bound).alias("comparable"))


@query("""
SELECT source_package, CASE WHEN source_package LIKE 'lib%' THEN 'c:libpkg,c:' || source_package || '_,u:' ELSE '' END || CASE WHEN source_package NOT LIKE 'lib%' THEN 'lib' || source_package ELSE substr(source_package, 4) END AS last_variant FROM sources
""")
def fn_name_variants(spark, sf_dir):
    s = Tables(spark, sf_dir).sources
    v = fn.name_variants("source_package")
    lib = F.get(F.filter(v, lambda x: x["kind"] == "uncertain"), F.lit(0))["name"]
    first = F.get(v, F.lit(0))["name"]
    return s.select("source_package", F.when(lib.isNotNull(), F.concat(F.lit("c:libpkg,c:"), "source_package", F.lit("_,u:"), lib)).otherwise(first).alias("last_variant"))


@query("SELECT attempts, least(900.0, 10.0 * pow(2, greatest(attempts, 1) - 1)) AS wait, count(*) AS n FROM history GROUP BY attempts")
def fn_backoff(spark, sf_dir):
    return Tables(spark, sf_dir).history.groupBy("attempts").agg(F.count("*").alias("n")).withColumn("wait", fn.backoff_seconds("attempts", 10, 900))


@query("SELECT event_id, CAST((epoch_us(ts) // 1000000 + 62135596800) // 604800 * 604800 - 62135596800 AS BIGINT) AS week, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def fn_period_and_json(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    return e.select("event_id", fn.truncate_period(F.col("ts").cast("timestamp"), 604800).alias("week"), fn.json_field("props", "$.k").cast("int").alias("k"))


@query("""
SELECT a.package_id AS a, b.package_id AS b, CASE WHEN a.code < b.code THEN -1 WHEN a.code > b.code THEN 1 ELSE 0 END AS sign FROM packages a JOIN packages b ON b.package_id = (a.package_id * 7 + 13) % (SELECT count(*) FROM packages)
""")
def fn_compare_versions(spark, sf_dir):
    p = Tables(spark, sf_dir).packages
    n = p.count()
    keyed = p.select("package_id", "version", fn.version_key("version").alias("key"))
    a, b = (keyed.select(*[F.col(c).alias(f"{c}_{x}") for c in keyed.columns]) for x in "ab")
    out = a.join(b, F.col("package_id_b") == (F.col("package_id_a") * 7 + 13) % n)
    return out.select(F.col("package_id_a").alias("a"), F.col("package_id_b").alias("b"), fn.compare_versions("version_a", "version_b", "key_a", "key_b").alias("sign"))


# Version ranges


def candidates(t: Tables) -> DataFrame:
    """Packages with their ranges in order of ``seq``; packages without ranges have an empty list."""
    ranges = t.ranges.groupBy("package_id").agg(F.sort_array(F.collect_list(F.struct("seq", "introduced", "fixed", "last_affected"))).alias("r"))
    ranges = ranges.select("package_id", F.transform("r", lambda x: F.struct(x["introduced"].alias("introduced"), x["fixed"].alias("fixed"), x["last_affected"].alias("last_affected"))).alias("ranges"))
    rows = t.packages.join(ranges, "package_id", "left")
    return rows.withColumnRenamed("version", "upstream_version")


DECIDED = """
k AS (SELECT * FROM ranges WHERE fixed <> 'deadbeef01'),
j AS (SELECT p.package_id, p.code, p.version, k.seq, k.fixed, seq % 6 IN (0, 1, 5) AS bounded, fixed = '*' AS star, seq % 6 = 3 AS opened, code >= intro_code AND CASE WHEN fixed_code > 0 OR seq % 6 = 5 THEN code < fixed_code ELSE code <= last_code END AS inside,
  seq % 6 = 3 AND code >= intro_code AS reached FROM packages p LEFT JOIN k USING (package_id)),
g AS (SELECT package_id, min(version) AS version, count(seq) AS n, coalesce(bool_or(bounded), false) AS has_bounded, min(CASE WHEN bounded AND inside THEN seq END) AS hit, arg_min(fixed, seq) FILTER (bounded AND inside) AS hit_fixed,
  coalesce(bool_or(star), false) AS star, coalesce(bool_or(reached), false) AS reached, coalesce(bool_or(opened), false) AS opened, arg_min(fixed, seq) FILTER (fixed NOT IN ('', '*')) AS first_fix FROM j GROUP BY package_id),
d AS (SELECT *, CASE WHEN n = 0 THEN false WHEN hit IS NOT NULL THEN true WHEN has_bounded THEN false WHEN star THEN true ELSE reached END AS affected, coalesce(hit_fixed, '') AS fixed_version,
  CASE WHEN n = 0 THEN 'none' WHEN hit IS NOT NULL OR has_bounded THEN 'high' WHEN star THEN 'all_versions' WHEN reached THEN 'low' ELSE 'none' END AS quality,
  CASE WHEN n = 0 THEN 'no-ranges' WHEN hit IS NOT NULL OR has_bounded THEN '' WHEN star THEN 'no-fix-available' WHEN reached THEN 'no-fixed-version' ELSE '' END AS flags,
  CASE WHEN has_bounded THEN 'high' WHEN star THEN 'all_versions' WHEN opened THEN 'low' ELSE 'none' END AS range_quality FROM g)
"""


@query(f"WITH {DECIDED} SELECT package_id, affected, fixed_version, quality, flags FROM d")
def version_range_match(spark, sf_dir):
    out = matching.match_versions(candidates(Tables(spark, sf_dir)))
    return out.select("package_id", "affected", "fixed_version", "quality", F.array_join("flags", ",").alias("flags"))


@query(f"WITH {DECIDED} SELECT package_id, range_quality FROM d")
def range_quality(spark, sf_dir):
    return candidates(Tables(spark, sf_dir)).select("package_id", matching.classify_range_quality(F.col("ranges")).alias("range_quality"))


@query(f"""
WITH {DECIDED}, e AS (SELECT *, CASE package_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'mapping' ELSE 'uncertain' END AS match_source,
  coalesce(TRY_CAST(split_part(fixed_version, '.', 1) AS INT) > TRY_CAST(split_part(version, '.', 1) AS INT) + 2, false) AS jump FROM d)
SELECT package_id, CASE WHEN n = 0 THEN 'detected' WHEN NOT affected THEN 'not-affected' WHEN match_source = 'uncertain' OR range_quality NOT IN ('high', 'all_versions') OR jump OR range_quality <> 'high' THEN 'detected' ELSE 'affected' END AS status,
  CASE WHEN n = 0 THEN 'low' WHEN NOT affected THEN CASE WHEN range_quality = 'high' THEN 'high' ELSE 'medium' END WHEN match_source = 'uncertain' OR range_quality NOT IN ('high', 'all_versions') OR jump THEN 'low' WHEN range_quality = 'high' THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN n > 0 AND NOT affected AND fixed_version = '' THEN coalesce((SELECT arg_min(r.fixed, r.seq) FROM ranges r WHERE r.package_id = e.package_id AND r.fixed NOT IN ('', '*')), '') ELSE fixed_version END AS upstream_fixed_version FROM e
""")
def disposition(spark, sf_dir):
    rows = candidates(Tables(spark, sf_dir)).withColumn("match_source", F.element_at(F.array(F.lit("direct"), F.lit("mapping"), F.lit("uncertain")), (F.col("package_id") % 3 + 1).cast("int")))
    return matching.disposition(matching.match_versions(rows)).select("package_id", "status", "confidence", "upstream_fixed_version")


# Names


NAMES = """
idx AS (SELECT DISTINCT package_name AS name FROM affected WHERE package_name <> ''), s AS (SELECT DISTINCT source_package AS name FROM sources),
c AS (SELECT s.name AS source_package, m.vuln_name AS n, 0 AS tier, 'mapping' AS match_source FROM s JOIN mappings m ON m.rpm_name = s.name
  UNION ALL SELECT name, name, 1, 'direct' FROM s UNION ALL SELECT name, 'lib' || name, 2, 'pattern' FROM s WHERE name NOT LIKE 'lib%' UNION ALL SELECT name, regexp_replace(name, '[0-9]+$', ''), 2, 'pattern' FROM s
  UNION ALL SELECT name, replace(name, '-', '_'), 2, 'pattern' FROM s WHERE contains(name, '-') UNION ALL SELECT s.name, product, 3, 'cpe' FROM s JOIN cpe USING (name) UNION ALL SELECT name, substr(name, 4), 5, 'uncertain' FROM s WHERE name LIKE 'lib%'),
h AS (SELECT DISTINCT c.* FROM c WHERE n IN (SELECT name FROM idx)), b AS (SELECT *, min(tier) OVER (PARTITION BY source_package) AS best FROM h)
"""


@query(f"WITH {NAMES} SELECT source_package, n AS vuln_name, match_source FROM b WHERE tier = best")
def name_resolution(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return matching.resolve_names(t.sources, lookups.vuln_name_index(t.affected), t.cpe, t.mappings)


@query("""
WITH names AS (SELECT DISTINCT vuln_id, package_name AS n FROM affected WHERE package_name <> ''), c AS (
  SELECT vuln_id, s.source_package, n, 0 AS tier, 'mapping' AS match_source FROM names JOIN mappings m ON m.vuln_name = n JOIN sources s ON s.source_package = m.rpm_name
  UNION ALL SELECT vuln_id, source_package, n, 1, 'direct' FROM names JOIN sources ON source_package = n
  UNION ALL SELECT vuln_id, source_package, n, 2, 'pattern' FROM names JOIN sources ON regexp_replace(source_package, '[0-9]+([.][0-9]+)*$', '') = n AND n <> source_package)
SELECT vuln_id, source_package, n AS matched_name, match_source FROM (SELECT *, row_number() OVER (PARTITION BY vuln_id, source_package ORDER BY n, tier) AS k FROM c) WHERE k = 1
""")
def find_affected(spark, sf_dir):
    t = Tables(spark, sf_dir)
    names = t.affected.filter("package_name != ''").select("vuln_id", F.col("package_name").alias("vuln_name"))
    return matching.find_affected_rpms(names, t.mappings, t.sources).select("vuln_id", "source_package", "matched_name", "match_source")


VENDORS = "SELECT 'CVE-' || CAST(p_partkey % 120 AS STRING) AS vuln_id, CASE WHEN p_partkey % 8 = 0 THEN '' WHEN p_partkey % 8 < 4 THEN 'npm' || lower(p_type) WHEN p_partkey % 8 < 6 THEN 'get' || lower(p_brand) ELSE 'acme' END AS vendor, lower(p_brand) AS package_name, CAST(p_partkey AS STRING) AS source, CAST(p_size AS STRING) AS fixed FROM {0}"


@query(f"""
WITH a AS ({VENDORS.format("part")}), pairs AS (SELECT DISTINCT vuln_id, package_name AS name FROM a),
v AS (SELECT DISTINCT pairs.vuln_id, name, vendor, vendor = '' OR vendor NOT LIKE 'npm%' OR starts_with(vendor, name) OR ends_with(vendor, name) AS fits FROM pairs JOIN a ON a.vuln_id = pairs.vuln_id AND a.package_name = name),
g AS (SELECT vuln_id, name, bool_and(fits) AS all_fit, bool_or(fits) AS any_fit, max(vendor) AS top FROM v GROUP BY vuln_id, name)
SELECT g.vuln_id, name AS source_package, (SELECT CASE WHEN top = '' OR all_fit THEN count(*) WHEN NOT any_fit THEN 0 ELSE CASE WHEN count(*) FILTER (EXISTS (SELECT 1 FROM v WHERE v.vuln_id = g.vuln_id AND v.name = g.name AND v.fits AND v.vendor = a.vendor)) > 0
  THEN count(*) FILTER (EXISTS (SELECT 1 FROM v WHERE v.vuln_id = g.vuln_id AND v.name = g.name AND v.fits AND v.vendor = a.vendor)) ELSE count(*) END END FROM a WHERE a.vuln_id = g.vuln_id) AS n_ranges FROM g
""")
def vendor_filter(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = spark.sql(VENDORS.format("{p}"), p=t.part)
    a = a.withColumn("ranges", F.array(F.struct(F.lit("").alias("introduced"), F.col("fixed").alias("fixed"), F.lit("").alias("last_affected"))))
    pairs = a.select("vuln_id", F.col("package_name").alias("source_package"), F.col("package_name").alias("matched_name")).distinct()
    out = matching.select_vendor_ranges(pairs, a)
    return out.select("vuln_id", "source_package", F.size("ranges").cast("long").alias("n_ranges"))


@query("SELECT name, cves FROM (SELECT lower(package_name) AS name, count(DISTINCT vuln_id) AS cves FROM affected WHERE package_name <> '' GROUP BY 1) WHERE cves >= 3 ORDER BY cves DESC, name LIMIT 3000")
def frequent_names(spark, sf_dir):
    return matching.frequent_vuln_names(Tables(spark, sf_dir).affected, 3)


@query("""
WITH c AS (SELECT lower(package_name) AS name, count(DISTINCT vuln_id) AS cves FROM affected WHERE package_name <> '' GROUP BY 1), s AS (SELECT DISTINCT source_package AS name, split_part(source_package, '-', 1) AS part FROM sources),
u AS (SELECT * FROM s WHERE name NOT IN (SELECT name FROM c) AND regexp_replace(name, '[0-9]+([.][0-9]+)*$', '') NOT IN (SELECT name FROM c) AND (name NOT LIKE 'lib%' OR substr(name, 4) NOT IN (SELECT name FROM c))),
r AS (SELECT u.name, c.name AS sim, cves, row_number() OVER (PARTITION BY u.name ORDER BY cves DESC, c.name) AS n FROM u JOIN c ON contains(c.name, u.part))
SELECT u.name AS source_package, coalesce((SELECT string_agg(sim || ':' || CAST(cves AS STRING), ',' ORDER BY n) FROM r WHERE r.name = u.name AND n <= 5), '') AS similar FROM u
""")
def unmapped_candidates(spark, sf_dir):
    t = Tables(spark, sf_dir)
    told = t.sources.select(F.col("source_package").alias("name"), F.lit("text").alias("description"))
    return matching.unmapped_candidates(t.sources, t.affected, told, t.findings).select("source_package", "similar")


@query("""
SELECT lower(package_name) AS name, vuln_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n FROM affected WHERE package_name <> '' AND source IN ('nvd', 'osv') GROUP BY 1, 2
""")
def vuln_index(spark, sf_dir):
    a = Tables(spark, sf_dir).affected.withColumn("ranges", F.array(F.struct(F.lit("0").alias("introduced"), F.lit("").alias("fixed"), F.lit("").alias("last_affected"))))
    return matching.build_vuln_index(a, ["nvd", "osv"]).select("name", "vuln_id", F.array_join("sources", ",").alias("sources"), F.size("ranges").cast("long").alias("n"))


@query("SELECT lower('src' || CAST(p_partkey % 90 AS STRING)) AS source_package, min(CAST(p_size AS STRING) || '.1') FILTER (p_partkey < 90) AS upstream_version, count(DISTINCT p_name) AS n_binaries FROM part GROUP BY 1")
def source_packages(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    purl = F.concat(F.lit("pkg:rpm/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("?upstream=SRC"), (F.col("p_partkey") % 90).cast("string"), F.lit("-"), F.col("p_size").cast("string"), F.lit(".1-1.src.rpm"))
    rows = p.select(F.col("p_name").alias("name"), F.lit("1").alias("version"), purl.alias("purl"))
    out = matching.source_packages(rows, fn.parse_source_rpm("purl", "name", "version"))
    return out.select("source_package", "upstream_version", F.size("binaries").cast("long").alias("n_binaries"))


def with_ranges(t: Tables) -> DataFrame:
    """Affected entries with one range each, from their package's number."""
    n = F.regexp_extract("package_name", r"(\d+)$", 1).try_cast("int")
    one = F.struct(F.lit("0").alias("introduced"), F.concat((F.coalesce(n, F.lit(0)) % 60).cast("string"), F.lit(".5")).alias("fixed"), F.lit("").alias("last_affected"))
    return t.affected.withColumn("ranges", F.filter(F.array(one), lambda r: F.coalesce(n % 9 != 0, F.lit(True))))


#: What becomes of e (source_package, vuln_id, match_source, num): ``num`` is the package's number, of which every ninth has no range.
DECISION = """j AS (SELECT e.*, upstream_version, rpm_version, CAST(split_part(upstream_version, '.', 1) AS INT) AS major, num % 60 AS fix FROM e JOIN sources USING (source_package)),
d AS (SELECT *, num % 9 = 0 AS unknown, major * 10 + 1 < fix * 10 + 5 AS inside, match_source = 'uncertain' AS review, fix > major + 2 AS jump, CAST(fix AS STRING) || '.5' AS fixed FROM j)
SELECT source_package, vuln_id, CASE WHEN unknown THEN 'detected' WHEN NOT inside THEN 'not-affected' WHEN review OR jump THEN 'detected' ELSE 'affected' END AS status,
  CASE WHEN unknown THEN 'low' WHEN NOT inside THEN 'high' WHEN review OR jump THEN 'low' ELSE 'high' END AS confidence, match_source, upstream_version, rpm_version, CASE WHEN unknown THEN '' ELSE fixed END AS upstream_fixed_version,
  CASE WHEN unknown THEN 'no-ranges' WHEN inside AND NOT review AND jump THEN 'suspicious-version-jump' ELSE '' END AS flags,
  CASE WHEN unknown THEN 'CVE matched by name but no version range data — needs review' WHEN NOT inside THEN 'Version ' || upstream_version || ' >= fix ' || fixed WHEN review THEN 'Needs agent review — low-quality range data' ELSE '' END AS notes FROM d
"""
RANGED = "a AS (SELECT *, TRY_CAST(regexp_extract(package_name, '([0-9]+)$', 1) AS INT) AS num FROM affected)"


@query(f"""
WITH {RANGED}, n AS (SELECT DISTINCT vuln_id, package_name AS n FROM a WHERE package_name <> ''), c AS (
  SELECT vuln_id, s.source_package, n, 0 AS tier FROM n JOIN mappings m ON m.vuln_name = n JOIN sources s ON s.source_package = m.rpm_name
  UNION ALL SELECT vuln_id, source_package, n, 1 FROM n JOIN sources ON source_package = n UNION ALL SELECT vuln_id, source_package, n, 2 FROM n JOIN sources ON regexp_replace(source_package, '[0-9]+([.][0-9]+)*$', '') = n AND n <> source_package),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vuln_id, source_package ORDER BY n, tier) AS k FROM c) WHERE k = 1),
e AS (SELECT DISTINCT f.vuln_id, f.source_package, CASE tier WHEN 0 THEN 'mapping' WHEN 1 THEN 'direct' ELSE 'pattern' END AS match_source, num FROM f JOIN a ON a.vuln_id = f.vuln_id AND a.package_name = f.n), {DECISION}
""")
def match_cves(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return matching.match_cves(with_ranges(t), t.sources, t.mappings, scope="name").withColumn("flags", F.array_join("flags", ","))


@query(f"""
WITH {RANGED}, {NAMES}, r AS (SELECT source_package, n, match_source FROM b WHERE tier = best),
e AS (SELECT source_package, vuln_id, arg_min(match_source, n) AS match_source, arg_min(num, n) AS num FROM r JOIN a ON a.package_name = n GROUP BY source_package, vuln_id), {DECISION}
""")
def match_packages(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return matching.match_packages(t.sources, with_ranges(t), t.cpe, t.mappings)[0].withColumn("flags", F.array_join("flags", ","))


#: All names that a package may go by, with the rank of the first way to each, and the vulnerabilities that list them.
BULK = f"""{RANGED}, c AS (SELECT source_package, vuln_name AS n, 0 AS rank FROM sources JOIN mappings ON rpm_name = source_package UNION ALL SELECT source_package, source_package, 1 FROM sources
  UNION ALL SELECT source_package, product, 2 FROM sources JOIN cpe ON name = source_package UNION ALL SELECT source_package, 'lib' || source_package, 3 FROM sources WHERE source_package NOT LIKE 'lib%'
  UNION ALL SELECT source_package, regexp_replace(source_package, '[0-9]+$', ''), 3 FROM sources UNION ALL SELECT source_package, replace(source_package, '-', '_'), 3 FROM sources WHERE contains(source_package, '-')
  UNION ALL SELECT source_package, substr(source_package, 4), 3 FROM sources WHERE source_package LIKE 'lib%'),
m AS (SELECT source_package, n, min(rank) AS rank FROM c GROUP BY source_package, n), i AS (SELECT DISTINCT package_name AS n, vuln_id, num FROM a WHERE package_name <> ''),
x AS (SELECT source_package, vuln_id, n, rank, num, CAST(split_part(upstream_version, '.', 1) AS INT) * 10 + 1 < num % 60 * 10 + 5 AS inside, CAST(num % 60 AS STRING) || '.5' AS fixed FROM m JOIN i USING (n) JOIN sources USING (source_package))"""


@query(f"""
WITH {BULK} SELECT source_package, vuln_id, n AS vuln_name, fixed AS fixed_version, 'medium' AS confidence FROM x WHERE num % 9 <> 0 AND inside QUALIFY row_number() OVER (PARTITION BY source_package, vuln_id ORDER BY rank, n) = 1
""")
def bulk_match(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return matching.bulk_match(t.sources, matching.build_vuln_index(with_ranges(t)), t.cpe, t.mappings)


@query(f"""
WITH {BULK}, y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY source_package, vuln_id ORDER BY rank, n) = 1)
SELECT source_package, vuln_id, CASE WHEN inside THEN 'detected' ELSE 'not-affected' END AS status, 'medium' AS confidence, fixed AS upstream_fixed_version, 'name:' || n AS match_type, '' AS flags FROM y WHERE num % 9 <> 0
""")
def bulk_advisories(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return matching.bulk_advisories(t.sources, matching.build_vuln_index(with_ranges(t)), t.cpe, t.mappings).withColumn("flags", F.array_join("flags", ","))


@query("""
WITH a AS (SELECT DISTINCT vuln_id, TRY_CAST(substr(package_name, 4) AS BIGINT) AS num FROM affected WHERE purl = ''),
hit AS (SELECT package_id, version, vuln_id, string_agg(DISTINCT CAST(num % 60 AS STRING) || '.5', ', ' ORDER BY CAST(num % 60 AS STRING) || '.5') AS fixes FROM packages JOIN a ON num // 16 = package_id // 16 WHERE num % 9 <> 0 AND code < (num % 60) * 10000 + 500 GROUP BY ALL),
listed AS (SELECT package_id, version, count(*) AS n, string_agg(vuln_id || ' ' || fixes, '; ' ORDER BY vuln_id) AS findings FROM hit GROUP BY ALL)
SELECT platform_id, 'PKG' || CAST(package_id // 16 AS STRING) AS package_name, version AS package_version, n, findings FROM platform_packages JOIN listed USING (package_id)
""")
def scan_platforms(spark, sf_dir):
    """Every finding of every platform, with its fixes, listed by package; sixteen packages share a name, so a name has many versions and many ranges."""
    t = Tables(spark, sf_dir)
    shared = lambda prefix, n: F.concat(F.lit(prefix), F.floor(n / 16).cast("string"))
    packages = t.packages.withColumn("name", shared("PKG", F.col("package_id")))
    # An entry keeps the range of its own number.
    affected = with_ranges(t).withColumn("package_name", F.coalesce(shared("pkg", F.substring("package_name", 4, 20).try_cast("long")), F.lit("")))
    v = t.vulnerabilities.select("id").withColumn("severity", F.array().cast("array<struct<type:string,score:string>>"))
    # The stand-in's rows before its DISTINCT, which would be one more shuffle: the operator takes each pair once.
    on = t.lineitem.select(F.col("l_orderkey").alias("platform_id"), F.col("l_partkey").alias("package_id"))
    text = F.array_join(F.transform("findings", lambda f: F.concat(f["vuln_id"], F.lit(" "), f["fixed_versions"])), "; ")
    found = matching.list_findings(on, packages, affected, v, columns={"n": F.size("findings").cast("long"), "findings": text})
    return found.drop("package_id")


# From records to the feed


def _records(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalised records of all parts, and the parts as source packages: three of four records are NVD's, by a fix, between bounds with an exclusive start, of all versions; one is OSV's with a SemVer fix."""
    p = t.part.withColumn("k", F.col("p_partkey").cast("string"))
    k, size = F.col("p_partkey"), F.col("p_size")
    dotted = lambda c: F.concat(c.cast("string"), F.lit(".0"))
    match = F.struct(
        F.lit(True).alias("vulnerable"), F.concat(F.lit("cpe:2.3:a:maker:prod"), "k", F.lit(":*:*")).alias("criteria"), F.when(k % 4 == 1, dotted(size + k % 3 - 1)).alias("versionStartExcluding"),
        F.when(k % 4 == 1, dotted(size + 1)).alias("versionEndIncluding"), F.when(k % 4 == 0, dotted(F.greatest(F.lit(1), size + k % 7 - 3))).alias("versionEndExcluding"),
    )
    score = F.struct(F.struct(F.lit("3.1").alias("version"), F.lit("x").alias("vectorString"), (size % 10 + 0.5).cast("double").alias("baseScore")).alias("cvssData"))
    ident = F.concat(F.lit("CVE-"), "k")
    nvd = _json(id=ident, configurations=F.array(F.struct(F.array(F.struct(F.array(match).alias("cpeMatch"))).alias("nodes"))), metrics=F.struct(F.array(score).alias("cvssMetricV31")))
    none = F.lit(None).cast("string")
    fix = F.concat(size.cast("string"), F.when(k % 8 == 3, ".0.1-rc.1").otherwise(".0.0-rc.1"))
    events = F.array(F.struct(F.lit("0").alias("introduced"), none.alias("fixed")), F.struct(none.alias("introduced"), fix.alias("fixed")))
    package = F.struct(F.lit("npm").alias("ecosystem"), F.concat(F.lit("prod"), "k").alias("name"))
    osv = _json(id=ident, affected=F.array(F.struct(package.alias("package"), F.array(F.struct(F.lit("SEMVER").alias("type"), events.alias("events"))).alias("ranges"))))
    bronze = p.select(F.when(k % 4 == 3, "pypa").otherwise("nvd").alias("source"), F.when(k % 4 == 3, osv).otherwise(nvd).alias("content"))
    v, a = normalize.normalize(bronze, ["nvd", "pypa"])
    sources = p.select(F.concat(F.lit("prod"), "k").alias("source_package"), dotted(size).alias("upstream_version"), F.concat(dotted(size), F.lit("-1")).alias("rpm_version"), "p_partkey")
    return v, a, sources


RECORDS = """r AS (SELECT p_partkey AS k, p_size AS s, p_retailprice AS price, greatest(1, p_size + p_partkey % 7 - 3) AS f FROM part),
held AS (SELECT *, CASE k % 4 WHEN 0 THEN s < f WHEN 1 THEN k % 3 = 0 WHEN 2 THEN true ELSE k % 8 = 3 END AS hit FROM r)"""


@query(f"""
WITH {RECORDS} SELECT 'prod' || CAST(k AS STRING) AS source_package, 'ADV-CVE-' || CAST(k AS STRING) AS id,
  CASE WHEN NOT hit THEN 'not-affected' WHEN k % 4 = 2 OR (k % 4 = 0 AND f > s + 2) THEN 'detected' ELSE 'affected' END AS status,
  CASE WHEN hit AND k % 4 = 0 AND f <= s + 2 THEN CAST(f AS STRING) || '.0' WHEN hit AND k % 4 = 3 THEN CAST(s AS STRING) || '.0.1-rc.1' END AS "limit",
  CASE WHEN k % 4 <> 3 THEN CAST(s % 10 AS STRING) || '.5' END AS score, price AS epss, k % 9 = 0 AS in_kev FROM held
""")
def records_to_feed(spark, sf_dir):
    """Raw records through normalisation, matching with exclusive starts and enrichment to feed documents."""
    t = Tables(spark, sf_dir)
    v, a, sources = _records(t)
    none = spark.createDataFrame([], "rpm_name string, vuln_name string")
    adv = matching.match_cves(a, sources, none, scope="name", honor_exclusive=True)
    epss = t.part.select(F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string")).alias("cve_id"), F.col("p_retailprice").alias("score"))
    told = matching.enrich_advisories(adv, v, epss, epss.filter("cast(substr(cve_id, 5) as bigint) % 9 = 0")).withColumn("distro_fixed_version", F.lit(""))
    doc = matching.to_osv(told, "ADV-", "Some Linux", "pkg:rpm/some/")
    get = lambda p: F.get_json_object("doc", p)
    return doc.join(told.select("source_package", "vuln_id", "epss", "in_kev"), ["source_package", "vuln_id"]).select(
        "source_package", get("$.id").alias("id"), get("$.database_specific.status").alias("status"), get("$.affected[0].ranges[0].events[1].limit").alias("limit"), get("$.severity[0].score").alias("score"), "epss", "in_kev"
    )


@query(f"""
WITH {RECORDS} SELECT l_orderkey AS platform_id, count(*) AS findings, count(*) FILTER (k % 4 <> 3) AS scored, count(*) FILTER (k % 4 IN (0, 3)) AS fixable FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN held ON k = l_partkey WHERE hit GROUP BY l_orderkey
""")
def scan_records(spark, sf_dir):
    """Findings of every platform against normalised records, by the order of each range's type."""
    t = Tables(spark, sf_dir)
    v, a, sources = _records(t)
    packages = sources.select(F.col("p_partkey").alias("package_id"), F.upper("source_package").alias("name"), F.col("upstream_version").alias("version"), F.lit("").alias("purl"))
    found = matching.scan_platforms(t.platform_packages, packages, a, v, honor_exclusive=True)
    return found.groupBy("platform_id").agg(F.count("*").alias("findings"), F.count("severity").alias("scored"), F.count_if(F.col("fixed_versions") != "").alias("fixable"))


@query("""
WITH s AS (SELECT package_id AS id, code // 10000 AS a, package_id % 20 AS b, package_id % 7 AS c, package_id % 3 AS e FROM packages),
n AS (SELECT *, a * 10000 + b * 100 + c AS plain, e * 1000000 + a * 10000 + b * 100 + c AS with_epoch, a * 10000 + b * 100 + CASE WHEN c = 0 THEN 99 ELSE c END AS pre FROM s)
SELECT x.id AS a, y.id AS b, CAST(sign(x.pre - y.pre) AS INT) AS semver, CAST(sign(x.with_epoch - y.with_epoch) AS INT) AS rpm, CAST(sign(x.pre - y.pre) AS INT) AS deb, CAST(sign(x.pre - y.pre) AS INT) AS maven
FROM n x JOIN n y ON y.id = (x.id * 7 + 13) % (SELECT count(*) FROM packages)
""")
def order_versions(spark, sf_dir):
    """Two versions of each package's numbers in the spelling of four ecosystems: an epoch, or a candidate ``c`` of a release (none: the release itself)."""
    p = Tables(spark, sf_dir).packages
    text = lambda c: c.cast("string")
    a, b, c, e = text(F.floor(F.col("code") / 10000)), text(F.col("package_id") % 20), text(F.col("package_id") % 7), text(F.col("package_id") % 3)
    final = F.col("package_id") % 7 == 0
    core = F.concat(a, F.lit("."), b)
    keyed = p.select(
        F.col("package_id").alias("id"),
        ordering.semver_key(F.concat(core, F.when(final, ".0").otherwise(F.concat(F.lit(".0-rc."), c)))).alias("semver"),
        ordering.rpm_key(F.concat(e, F.lit(":"), core, F.lit("-"), c, F.lit(".el9"))).alias("rpm"),
        ordering.deb_key(F.concat(core, F.when(final, "-1").otherwise(F.concat(F.lit("~rc"), c, F.lit("-1"))))).alias("deb"),
        ordering.maven_key(F.concat(core, F.when(final, "-final").otherwise(F.concat(F.lit("-cr-"), c)))).alias("maven"),
    )
    n = p.count()
    other = keyed.select(*[F.col(x).alias(f"{x}_b") for x in keyed.columns])
    sign = lambda k: F.when(F.col(k) < F.col(f"{k}_b"), -1).when(F.col(k) > F.col(f"{k}_b"), 1).otherwise(0).alias(k)
    return keyed.join(other, F.col("id_b") == (F.col("id") * 7 + 13) % n).select(F.col("id").alias("a"), F.col("id_b").alias("b"), *map(sign, ("semver", "rpm", "deb", "maven")))


# Advisories


@query("""
SELECT source_package, vuln_id, 'ADV-' || vuln_id AS id, status, CASE WHEN status = 'fixed' THEN nullif(upstream_fixed_version, '') END AS fixed, CASE WHEN status = 'affected' THEN nullif(upstream_fixed_version, '') END AS "limit" FROM advisories WHERE status IN ('affected', 'fixed')
""")
def osv_feed(spark, sf_dir):
    adv = Tables(spark, sf_dir).advisories.withColumns({"distro_fixed_version": F.lit(""), "upstream_version": F.lit("1"), "rpm_version": F.lit("1-1"), "cvss_score": F.col("cvss").cast("string")})
    doc = matching.to_osv(lookups.feed_input(adv), "ADV-", "Some Linux", "pkg:rpm/some/")
    get = lambda p: F.get_json_object("doc", p)
    event = "$.affected[0].ranges[0].events[1]"
    return doc.select("source_package", "vuln_id", get("$.id").alias("id"), get("$.database_specific.status").alias("status"), get(f"{event}.fixed").alias("fixed"), get(f"{event}.limit").alias("limit"))


@query("""
SELECT source_package, vuln_id, score AS epss, cve_id2 IS NOT NULL AS in_kev FROM advisories LEFT JOIN (SELECT cve_id AS vuln_id, score FROM epss) USING (vuln_id) LEFT JOIN (SELECT DISTINCT cve_id AS cve_id2 FROM kev) ON cve_id2 = vuln_id
""")
def enrich_advisories(spark, sf_dir):
    t = Tables(spark, sf_dir)
    v = t.vulnerabilities.filter("id like 'CVE%'").select("id").withColumn("severity", F.array().cast("array<struct<type:string,score:string>>"))
    return matching.enrich_advisories(t.advisories.drop("epss"), v, t.epss, t.kev).select("source_package", "vuln_id", "epss", "in_kev")


ANSWERS = "SELECT source_package, vuln_id, CASE WHEN cvss > 40 THEN 'affected' ELSE 'not-affected' END AS status, 'high' AS confidence, 'seen' AS reasoning FROM {0} WHERE vuln_id LIKE '%5' OR vuln_id LIKE '%6'"


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY source_package ORDER BY vuln_id) AS n FROM advisories), a AS ({ANSWERS.format("advisories")})
SELECT r.source_package, r.vuln_id, CASE WHEN n > 15 THEN 'detected' ELSE coalesce(a.status, 'under-review') END AS status, CASE WHEN n > 15 THEN 'low' ELSE coalesce(a.confidence, 'low') END AS confidence FROM r LEFT JOIN a USING (source_package, vuln_id)
""")
def merge_assessments(spark, sf_dir):
    adv = Tables(spark, sf_dir).advisories
    return matching.merge_assessments(adv, spark.sql(ANSWERS.format("{a}"), a=adv))


@query(f"""
WITH a AS ({ANSWERS.format("advisories")}) SELECT o.source_package, o.vuln_id, o.status AS old_status, a.status AS new_status, a.confidence, a.reasoning AS notes FROM advisories o JOIN a USING (source_package, vuln_id) WHERE o.status <> a.status
""")
def review_delta(spark, sf_dir):
    adv = Tables(spark, sf_dir).advisories
    return matching.review_delta(adv, spark.sql(ANSWERS.format("{a}"), a=adv))


@query(f"""
WITH a AS ({ANSWERS.format("advisories")}) SELECT o.source_package, o.vuln_id, CASE WHEN o.status = 'detected' AND a.status IS NOT NULL THEN a.status ELSE o.status END AS status FROM advisories o LEFT JOIN a USING (source_package, vuln_id)
""")
def triage_merge(spark, sf_dir):
    adv = Tables(spark, sf_dir).advisories
    return matching.apply_triage(adv, spark.sql(ANSWERS.format("{a}"), a=adv)).select("source_package", "vuln_id", "status")


@query("""
SELECT source_package, vuln_id FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN status = 'detected' THEN 0 ELSE 1 END, CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 END, vuln_id, source_package) AS n FROM advisories) ORDER BY n
""")
def sorted_advisories(spark, sf_dir):
    return lookups.sort_advisories(Tables(spark, sf_dir).advisories.withColumn("severity", F.col("confidence"))).select("source_package", "vuln_id")


# Records


@query("""
SELECT conv_id, turn, 'CVE-' || CAST(conv_id AS STRING) AS cve_id, CASE turn % 3 WHEN 0 THEN 'affected' WHEN 1 THEN 'under-review' ELSE 'not-affected' END AS status, CASE WHEN turn % 2 = 0 THEN 'high' ELSE 'low' END AS confidence, text AS reasoning
FROM conversations WHERE turn % 4 <> 3
""")
def parse_assessments(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations
    status = F.element_at(F.array(F.lit("affected"), F.lit("sure"), F.lit("not-affected")), (F.col("turn") % 3 + 1).cast("int"))
    item = F.to_json(F.struct(F.concat(F.lit("CVE-"), F.col("conv_id").cast("string")).alias("cve_id"), status.alias("status"), F.when(F.col("turn") % 2 == 0, "high").otherwise("certain").alias("confidence"), F.col("text").alias("reasoning")))
    fence = F.lit("```json\n")
    answer = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("Here: "), fence, F.lit("["), item, F.lit("]\n```"))).when(F.col("turn") % 4 == 1, F.concat(F.lit("["), item, F.lit(', {"cve_id": "cut')))
    answer = answer.when(F.col("turn") % 4 == 2, F.concat(F.lit("["), item, F.lit("]"))).otherwise(F.lit("no list"))
    return normalize.parse_assessments(c.select("conv_id", "turn", answer.alias("text"))).drop("text")


@query("SELECT p_partkey, 'rpm' || CAST(p_partkey AS STRING) AS rpm_name, 'up_' || CAST(p_partkey % 50 AS STRING) AS vuln_name FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'x' || CAST(p_partkey AS STRING), 'y' || CAST(p_size AS STRING) FROM part WHERE p_partkey % 2 = 1")
def mapping_proposals(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    n = F.col("p_partkey").cast("string")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("The RPM RPM"), n, F.lit(" maps to upstream 'UP_"), (F.col("p_partkey") % 50).cast("string"), F.lit("'"))).otherwise(F.concat(F.lit("x"), n, F.lit(" in NVD is y"), F.col("p_size").cast("string")))
    return normalize.extract_mapping_proposals(p.select("p_partkey", text.alias("text"))).drop("text")


def _json(**cols) -> F.col:
    return F.to_json(F.struct(*[c.alias(n) for n, c in cols.items()]))


@query("""
SELECT 'OSV-' || CAST(p_partkey AS STRING) AS vuln_id, p_name AS package_name, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '0:' || CASE p_partkey % 4 WHEN 1 THEN CAST(p_size AS STRING) WHEN 2 THEN CAST(p_size + 1 AS STRING) ELSE '' END || ':' || CASE WHEN p_partkey % 4 = 3 THEN '9' ELSE '' END END AS ranges,
  CASE WHEN p_partkey % 4 = 0 THEN 'empty_range' ELSE 'unbounded_range' END AS flags, 'alias' || CAST(p_partkey AS STRING) AS alias FROM part
""")
def normalize_osv(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    none = F.lit(None).cast("string")
    event = lambda **e: F.struct(*[e.get(x, none).alias(x) for x in ("introduced", "fixed", "last_affected", "limit")])
    second = event(fixed=F.when(k == 1, size), limit=F.when(k == 2, (F.col("p_size") + 1).cast("string")), last_affected=F.when(k == 3, F.lit("9")))
    ranges = F.when(k == 0, F.array().cast("array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string,limit:string>>>>")).otherwise(
        F.array(F.struct(F.lit("SEMVER").alias("type"), F.array(event(introduced=F.lit("0")), second).alias("events")))
    )
    package = F.struct(F.lit("npm").alias("ecosystem"), F.col("p_name").alias("name"), F.lit("").alias("purl"))
    record = _json(id=F.concat(F.lit("OSV-"), F.col("p_partkey").cast("string")), aliases=F.array(F.concat(F.lit("alias"), F.col("p_partkey").cast("string"))), affected=F.array(F.struct(package.alias("package"), ranges.alias("ranges"))))
    v, a = normalize.normalize_osv(p.select(record.alias("content")))
    shown = F.array_join(F.transform("ranges", lambda r: F.concat_ws(":", r["introduced"], r["fixed"], r["last_affected"])), ",")
    return a.join(v.select(F.col("id").alias("vuln_id"), F.get("aliases", F.lit(0)).alias("alias")), "vuln_id").select("vuln_id", "package_name", shown.alias("ranges"), F.array_join("flags", ",").alias("flags"), "alias")


@query("""
SELECT 'CVE-' || CAST(p_partkey AS STRING) AS vuln_id, 'v' || CAST(p_size AS STRING) AS vendor, 'prod' || CAST(p_partkey AS STRING) AS package_name,
  CASE p_partkey % 4 WHEN 0 THEN '0:*::false' WHEN 1 THEN '1.0:' || CAST(p_size AS STRING) || '::false' WHEN 2 THEN '1.0::2.' || CAST(p_size AS STRING) || ':true' ELSE '' END AS ranges,
  CASE p_partkey % 4 WHEN 0 THEN 'all_versions_affected' ELSE '' END AS flags, CASE WHEN p_partkey % 4 = 3 THEN '7.' || CAST(p_size AS STRING) ELSE '' END AS versions, 'CVSS_V3_1' AS severity FROM part
""")
def normalize_nvd(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    k, size, n = F.col("p_partkey") % 4, F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    version = F.when(k == 3, F.concat(F.lit("7."), size)).otherwise("*")
    match = F.struct(
        F.lit(True).alias("vulnerable"), F.concat(F.lit("cpe:2.3:a:v"), size, F.lit(":prod"), n, F.lit(":"), version, F.lit(":*")).alias("criteria"), F.when(k == 1, "1.0").alias("versionStartIncluding"),
        F.when(k == 2, "1.0").alias("versionStartExcluding"), F.when(k == 2, F.concat(F.lit("2."), size)).alias("versionEndIncluding"), F.when(k == 1, size).alias("versionEndExcluding"),
    )
    child = F.struct(F.array(match).alias("cpeMatch"))
    score = F.struct(F.struct(F.lit("3.1").alias("version"), F.lit("x").alias("vectorString"), F.lit(7.5).alias("baseScore")).alias("cvssData"))
    record = _json(id=F.concat(F.lit("CVE-"), n), configurations=F.array(F.struct(F.array(F.struct(F.array(child).alias("children"))).alias("nodes"))), metrics=F.struct(F.array(score).alias("cvssMetricV31")))
    v, a = normalize.normalize_nvd(p.select(record.alias("content")))
    shown = F.array_join(F.transform("ranges", lambda r: F.concat_ws(":", r["introduced"], r["fixed"], r["last_affected"], r["introduced_exclusive"].cast("string"))), ",")
    return a.join(v.select(F.col("id").alias("vuln_id"), F.get("severity", F.lit(0))["type"].alias("severity")), "vuln_id").select(
        "vuln_id", "vendor", "package_name", shown.alias("ranges"), F.array_join("flags", ",").alias("flags"), F.array_join("versions", ",").alias("versions"), "severity"
    )


@query("""
SELECT 'CVE-' || CAST(p_partkey AS STRING) AS vuln_id, p_name AS package_name, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS STRING) || ':' || CAST(p_size AS STRING) || '.' || CAST(p_partkey % 13 + 1 AS STRING) || ':,90::' WHEN 1 THEN '0:' || CAST(p_size AS STRING) || ':' WHEN 2 THEN '1::' || CAST(p_size AS STRING) ELSE '' END AS ranges,
  CASE p_partkey % 4 WHEN 0 THEN 'no_upper_bound' WHEN 3 THEN 'empty_range,unbounded_range' ELSE '' END AS flags FROM part
""")
def normalize_cve_v5(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    k, size, n = F.col("p_partkey") % 4, F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    none = F.lit(None).cast("string")
    ver = lambda version, status, lt=none, le=none: F.struct(version.alias("version"), F.lit(status).alias("status"), lt.alias("lessThan"), le.alias("lessThanOrEqual"))
    versions = (
        F.when(k == 0, F.array(ver(F.lit("90"), "affected"), ver(size, "unaffected", lt=F.concat(size, F.lit("."), (F.col("p_partkey") % 13 + 1).cast("string"))), ver(size, "affected")))
        .when(k == 1, F.array(ver(F.lit("0"), "unaffected", lt=size)))
        .when(k == 2, F.array(ver(F.lit("1"), "affected", le=size)))
    )
    aff = F.struct(F.lit("acme").alias("vendor"), F.col("p_name").alias("product"), F.when(k == 2, "unaffected").otherwise("affected").alias("defaultStatus"), versions.alias("versions"))
    record = _json(cveMetadata=F.struct(F.concat(F.lit("CVE-"), n).alias("cveId"), F.lit("PUBLISHED").alias("state")), containers=F.struct(F.struct(F.array(aff).alias("affected")).alias("cna")))
    _, a = normalize.normalize_cve_v5(p.select(record.alias("content")))
    shown = F.array_join(F.transform("ranges", lambda r: F.concat_ws(":", r["introduced"], r["fixed"], r["last_affected"])), ",")
    return a.select("vuln_id", "package_name", shown.alias("ranges"), F.array_join("flags", ",").alias("flags"))


@query("""
SELECT 'CVE-2024-' || CAST(s_suppkey AS STRING) AS cve_id, s_name AS description, 'look' AS notes, CASE WHEN s_suppkey % 2 = 0 THEN 'DSA-1-1' ELSE '' END AS advisories,
  CASE WHEN s_suppkey % 3 = 0 THEN 'curl:unstable:8.' || CAST(s_suppkey AS STRING) || ':fixed:' ELSE 'curl:bookworm::not-affected:why' END AS packages FROM supplier
""")
def debian_notes(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier
    n = F.col("s_suppkey")
    lines = F.array(
        F.concat(F.lit("CVE-2024-"), n.cast("string"), F.lit(" ("), "s_name", F.lit(")")),
        F.when(n % 2 == 0, "\t{DSA-1-1}").otherwise("\tnothing"),
        F.when(n % 3 == 0, F.concat(F.lit("\t- curl 8."), n.cast("string"))).otherwise("\t[bookworm] - curl <not-affected> (why)"),
        F.lit("\tNOTE: look"),
        F.lit("end"),
    )
    rows = s.select(F.concat(F.lit("file"), (n % 7).cast("string")).alias("file"), n.alias("at"), F.posexplode(lines).alias("i", "line")).withColumn("pos", F.col("at") * 5 + F.col("i"))
    out = normalize.normalize_debian_notes(rows)
    shown = F.array_join(F.transform("packages", lambda p: F.concat_ws(":", p["package"], p["release"], p["version"], p["status"], p["note"])), ",")
    return out.select("cve_id", "description", F.array_join("notes", ",").alias("notes"), F.array_join("advisories", ",").alias("advisories"), shown.alias("packages"))


@query("""
SELECT CAST(o_orderkey AS STRING) AS platform_id, 'pkg' || CAST(o_custkey AS STRING) AS name, '1.' || CAST(o_orderkey % 9 AS STRING) AS version, CASE WHEN o_orderkey % 2 = 0 THEN 'rpm' ELSE 'unknown' END AS type,
  CASE WHEN o_orderkey % 2 = 0 THEN 'pkg:rpm/x' || CAST(o_custkey AS STRING) ELSE 'pkg:unknown/pkg' || CAST(o_custkey AS STRING) || '@1.' || CAST(o_orderkey % 9 AS STRING) END AS purl FROM orders
""")
def sbom_packages(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    ref = F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.when(k % 2 == 0, "purl").otherwise("cpe23Type").alias("referenceType"), F.concat(F.lit("pkg:rpm/x"), c).alias("referenceLocator"))
    pkg = F.struct(F.concat(F.lit("pkg"), c).alias("name"), F.concat(F.lit("1."), (k % 9).cast("string")).alias("versionInfo"), F.array(ref).alias("externalRefs"))
    return normalize.sbom_packages(o.select(k.cast("string").alias("platform_id"), _json(packages=F.array(pkg)).alias("content")))


@query("""
SELECT CAST(o_orderkey AS STRING) AS image_id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS STRING) ELSE 'd' || CAST(o_custkey AS STRING) END AS platform_id, 'linux' AS os, CASE WHEN o_orderkey % 3 = 0 THEN 'amd64' ELSE 'arm64' END AS architecture FROM orders WHERE o_orderkey % 3 <> 2
""")
def manifest_platforms(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    k = F.col("o_orderkey") % 3
    entry = F.struct(F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("digest"), F.when(k == 1, F.struct(F.lit("linux").alias("os"), F.lit("arm64").alias("architecture"))).alias("platform"))
    content = F.when(k == 0, F.lit('{"mediaType": "single"}')).otherwise(_json(manifests=F.array(entry)))
    return normalize.platforms_from_manifest(o.select(F.col("o_orderkey").cast("string").alias("image_id"), content.alias("content"))).drop("variant")


@query("SELECT 'CVE-' || CAST(p_partkey AS STRING) AS cve_id, p_name AS product, strptime('2024-01-0' || CAST(1 + p_partkey % 9 AS STRING), '%Y-%m-%d') AS date_added FROM part")
def kev_rows(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    entry = F.struct(F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string")).alias("cveID"), F.col("p_name").alias("product"), F.concat(F.lit("2024-01-0"), (1 + F.col("p_partkey") % 9).cast("string")).alias("dateAdded"),
        *[F.lit("").alias(x) for x in ("vendorProject", "dueDate", "shortDescription", "requiredAction", "notes")])
    out = normalize.normalize_kev(p.select(F.array(entry).alias("vulnerabilities")))
    return out.select("cve_id", "product", F.col("date_added").cast("timestamp_ntz").alias("date_added"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'docker.io' WHEN 1 THEN 'quay.io' ELSE 'localhost' END AS registry, CASE p_partkey % 3 WHEN 0 THEN 'library/app' ELSE 'org/app' END || CAST(p_size AS STRING) AS repository, 'v' || CAST(p_size AS STRING) AS tag FROM part")
def fn_image_ref(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    ref = fn.image_ref(F.concat(F.when(k == 0, "app").when(k == 1, "quay.io/org/app").otherwise("localhost/org/app"), size, F.lit(":v"), size))
    return p.select("p_partkey", ref["registry"].alias("registry"), ref["repository"].alias("repository"), ref["tag"].alias("tag"))


def _catalog(spark, sf_dir) -> dict[str, DataFrame]:
    """Orders as images with one platform and one package each; a tag event for each order."""
    o = Tables(spark, sf_dir).orders
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    entry = F.struct(F.concat(F.lit("d"), k.cast("string")).alias("digest"), F.struct(F.lit("linux").alias("os"), F.lit("arm64").alias("architecture")).alias("platform"))
    manifests = o.filter("o_orderkey % 3 != 0").select(k.cast("string").alias("image_id"), _json(manifests=F.array(entry)).alias("content"))
    tags = o.select(k.alias("event_id"), F.concat(F.lit("repo"), (k % 50).cast("string")).alias("repository"), F.when(k % 4 == 0, "v1.sig").otherwise("latest").alias("tag"), c.alias("image_id"), F.col("o_orderdate").alias("ts"))
    pkg = F.struct(F.concat(F.lit("pkg"), c).alias("name"), F.lit("1").alias("versionInfo"))
    sboms = o.select(F.concat(F.lit("d"), k.cast("string")).alias("platform_id"), _json(packages=F.array(pkg)).alias("content"))
    return catalog.build_catalog(manifests, tags, sboms)


@query("""
SELECT 'd' || CAST(o_orderkey AS STRING) AS platform_id, 'pkg:unknown/pkg' || CAST(o_custkey AS STRING) || '@1' AS purl FROM orders WHERE o_orderkey % 3 <> 0
""")
def catalog_packages(spark, sf_dir):
    return _catalog(spark, sf_dir)["platform_packages"]


@query("""
WITH e AS (SELECT o_orderkey AS id, 'repo' || CAST(o_orderkey % 50 AS STRING) AS repository, CAST(o_custkey AS STRING) AS image_id, o_orderdate AS ts FROM orders WHERE o_orderkey % 4 <> 0),
k AS (SELECT * FROM (SELECT *, lag(image_id) OVER (PARTITION BY repository ORDER BY ts, id) AS before FROM e) WHERE before IS NULL OR before <> image_id)
SELECT repository, image_id, ts AS valid_from, lead(ts) OVER (PARTITION BY repository ORDER BY ts, id) IS NULL AS current FROM k
""")
def catalog_tags(spark, sf_dir):
    return _catalog(spark, sf_dir)["tags"].select("repository", "image_id", "valid_from", "current")


@query("SELECT DISTINCT 'repo' || CAST(o_orderkey % 50 AS STRING) || ':latest' AS reference FROM orders WHERE o_orderkey % 4 <> 0")
def tag_references(spark, sf_dir):
    return _catalog(spark, sf_dir)["references"]


@query("SELECT source_package, vuln_id, status FROM advisories WHERE status IN ('affected', 'fixed')")
def feed_input(spark, sf_dir):
    return lookups.feed_input(Tables(spark, sf_dir).advisories).select("source_package", "vuln_id", "status")


@query("SELECT 's' || CAST(s_suppkey AS STRING) AS source, s_acctbal AS checkpoint_value FROM supplier ORDER BY 1")
def source_status(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier
    return lookups.source_status(s.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.col("s_acctbal").alias("checkpoint_value")))


@query("SELECT key FROM items WHERE created_at <= TIMESTAMP '1997-01-01 00:00:00'")
def eligible_items(spark, sf_dir):
    items = Tables(spark, sf_dir).items.withColumnRenamed("created_at", "not_before")
    return worklog.eligible(items, F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00"))).select("key")


@query("SELECT 'CVE-' || CAST(p_partkey AS STRING) AS cve_id, CAST(p_size AS DOUBLE) / 64 AS score, 'v' || CAST(p_size AS STRING) AS model_version FROM part")
def epss_rows(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    score = F.struct(F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string")).alias("cve"), (F.col("p_size") / 64).alias("epss"), F.lit(0.5).alias("percentile"))
    batch = _json(model_version=F.concat(F.lit("v"), F.col("p_size").cast("string")), score_date=F.lit("2024-01-01"), scores=F.array(score))
    return normalize.normalize_epss(p.select(batch.alias("content"))).select("cve_id", F.col("score").cast("double").alias("score"), "model_version")


@query("""
SELECT 'CVE-' || CAST(p_partkey AS STRING) AS vuln_id, p_name AS summary, 'prod' AS package_name, '0:' || CAST(p_size AS STRING) AS ranges, 'http://x/' || CAST(p_partkey AS STRING) AS ref FROM part
""")
def normalize_override(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    n = F.col("p_partkey").cast("string")
    match = F.struct(F.lit(True).alias("vulnerable"), F.lit("cpe:2.3:a:v:prod:*:*").alias("criteria"), F.lit("0").alias("versionStartIncluding"), F.col("p_size").cast("string").alias("versionEndExcluding"))
    note = F.struct(F.concat(F.lit("CVE-"), n).alias("cve_id"), F.col("p_name").alias("description"), F.array(F.concat(F.lit("http://x/"), n)).alias("references"))
    record = _json(_annotation=note, cve=F.struct(F.array(F.struct(F.array(F.struct(F.array(match).alias("cpeMatch"))).alias("nodes"))).alias("configurations")))
    v, a = normalize.normalize_nvd_override(p.select(record.alias("content")))
    first = F.get("ranges", F.lit(0))
    told = v.select(F.col("id").alias("vuln_id"), "summary", F.get("refs", F.lit(0))["url"].alias("ref"))
    return a.join(told, "vuln_id").select("vuln_id", "summary", "package_name", F.concat_ws(":", first["introduced"], first["fixed"]).alias("ranges"), "ref")


@query("""
SELECT CAST(o_orderkey AS STRING) AS platform_id, 2 AS layer_count, CAST(o_orderkey + 7 AS BIGINT) AS compressed_size, '22/tcp,80/tcp' AS ports FROM orders
""")
def platform_config(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    ports = F.create_map(F.lit("80/tcp"), F.lit("x"), F.lit("22/tcp"), F.lit("y"))
    content = _json(layers=F.array(F.struct(F.col("o_orderkey").alias("size")), F.struct(F.lit(7).cast("long").alias("size"))), config=F.struct(ports.alias("ExposedPorts")))
    out = normalize.platform_config(o.select(F.col("o_orderkey").cast("string").alias("platform_id"), content.alias("content")))
    return out.select("platform_id", "layer_count", "compressed_size", F.array_join("exposed_ports", ",").alias("ports"))
