"""Registered queries: lookups, joins, reports and histories, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.functions import is_valid_transition
from supplylens.operators import aggregates as agg
from supplylens.operators import bucketed, cdc, history, joins, lookups, merge, ngrams, sketches, windows
from supplylens.plans.standins import STANDINS, expand, standin
from supplylens.streaming import ordered, worklog

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = expand(oracle)
        return fn

    return add


def ts(text: str):
    return F.to_timestamp_ntz(F.lit(text))


class Tables:
    """Stand-ins and plain tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        from supplylens.plans.standins import STANDINS

        return standin(self._spark, self._dir, name) if name in STANDINS else self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def vulnerabilities(t: Tables) -> DataFrame:
    return t.vulnerabilities.withColumn("aliases", F.array("alias")).drop("alias")


@query("""
WITH pairs AS (SELECT platform_id AS from_id, platform_id + 1 AS to_id FROM platforms)
SELECT from_id, to_id, package_id, CASE WHEN max(side) = 1 THEN 'removed' ELSE 'added' END AS change FROM (
  SELECT from_id, to_id, package_id, 1 AS side FROM pairs JOIN platform_packages ON platform_id = from_id
  UNION ALL SELECT from_id, to_id, package_id, 2 FROM pairs JOIN platform_packages ON platform_id = to_id)
GROUP BY from_id, to_id, package_id HAVING count(*) = 1
""")
def package_diff(spark, sf_dir):
    t = Tables(spark, sf_dir)
    pairs = t.platforms.select(F.col("platform_id").alias("from_id"), (F.col("platform_id") + 1).alias("to_id"))
    return joins.diff_packages_pairs(t.platform_packages, pairs)


@query("""
SELECT DISTINCT image_id, name, created_at FROM images WHERE image_id IN (
  SELECT image_id FROM platforms WHERE platform_id IN (SELECT platform_id FROM platform_packages WHERE package_id IN (SELECT package_id FROM packages WHERE contains(lower(name), 'widget') AND contains(version, '.1.'))))
ORDER BY image_id LIMIT 1000
""")
def images_by_package(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return joins.images_by_package(t.images, t.platforms, t.platform_packages, t.packages, "Widget", ".1.", 1000)


@query("""
SELECT image_id, name, created_at FROM images WHERE image_id IN (
  SELECT image_id FROM platforms WHERE platform_id IN (SELECT platform_id FROM platform_packages WHERE package_id IN (SELECT package_id FROM packages WHERE purl LIKE 'pkg:rpm/%/7')))
""")
def images_by_purl(spark, sf_dir):
    t = Tables(spark, sf_dir)
    purl = t.packages.filter("package_id = 7").select("purl")
    hit = t.packages.join(purl, "purl", "left_semi")
    return joins._image_hits(t.images, t.platforms, t.platform_packages, hit)


@query("SELECT package_id, name, type, vendor, version, purl FROM packages WHERE contains(lower(name), 'ring') ORDER BY name, version, package_id LIMIT 500")
def search_packages(spark, sf_dir):
    return lookups.search_packages(Tables(spark, sf_dir).packages.drop("code"), "RING", 500)


@query("""
SELECT image_id, platform_id, package_id, type, name, version FROM platforms JOIN platform_packages USING (platform_id) JOIN packages USING (package_id) WHERE architecture = 'arm64'
""")
def image_packages(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return lookups.image_packages(t.platforms, t.platform_packages, t.packages, "arm64").select("image_id", "platform_id", "package_id", "type", "name", "version")


@query("""
SELECT image_id, name, coalesce((SELECT string_agg(CAST(platform_id AS STRING), ',' ORDER BY platform_id) FROM platforms p WHERE p.image_id = i.image_id), '') AS platforms FROM images i
""")
def image_document(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tags = t.images.select("image_id", F.lit("latest").alias("tag"), (F.col("image_id") % 2 == 0).alias("current"))
    doc = lookups.image_document(t.images, t.platforms, tags)
    return doc.select("image_id", "name", F.array_join(F.transform("platforms", lambda p: p["platform_id"].cast("string")), ",").alias("platforms"))


@query("SELECT image_id, min(platform_id) AS platform_id FROM platforms JOIN sboms USING (platform_id) WHERE architecture = 'amd64' AND source = 'syft' GROUP BY image_id")
def pick_sbom(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return lookups.pick_sbom(t.platforms, t.sboms).select("image_id", "platform_id")


@query("SELECT platform_id, image_id FROM platforms WHERE platform_id NOT IN (SELECT platform_id FROM sboms)")
def platforms_missing_sbom(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return joins.platforms_missing_sbom(t.platforms, t.sboms).select("platform_id", "image_id")


@query("SELECT count(*) AS n, min(platform_id) AS lo, max(platform_id) AS hi FROM platforms WHERE platform_id IN (SELECT platform_id FROM sboms)")
def has_sbom(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return lookups.has_sbom(t.platforms, t.sboms).agg(F.count("*").alias("n"), F.min("platform_id").alias("lo"), F.max("platform_id").alias("hi"))


@query("""
WITH q AS (SELECT 'pkg' || CAST(p_partkey AS STRING) AS name, CASE WHEN p_partkey % 2 = 0 THEN 'npm' END AS eco FROM part)
SELECT DISTINCT package_name, eco AS asked_ecosystem, vuln_id, count(DISTINCT vuln_id) OVER (PARTITION BY package_name, eco) AS total
FROM q JOIN affected ON package_name = name AND (eco IS NULL OR eco = ecosystem)
""")
def affected_by_package(spark, sf_dir):
    t = Tables(spark, sf_dir)
    names = t.part.select(F.concat(F.lit("pkg"), "p_partkey").alias("package_name"), F.when(F.col("p_partkey") % 2 == 0, "npm").alias("ecosystem"))
    return lookups.affected_by_package(t.affected, names)


@query("SELECT DISTINCT purl, vuln_id FROM affected WHERE purl IN (SELECT 'pkg:rpm/p' || CAST(p_partkey AS STRING) FROM part)")
def affected_by_purl(spark, sf_dir):
    t = Tables(spark, sf_dir)
    purls = t.part.select(F.concat(F.lit("pkg:rpm/p"), "p_partkey").alias("purl"))
    return lookups.affected_by_purl(t.affected, purls)


ASKED = """
SELECT CASE WHEN p_partkey % 5 = 0 THEN 'pkg:rpm/p' || CAST(p_partkey AS STRING) ELSE '' END AS purl, CASE WHEN p_partkey % 5 = 1 THEN 'vendor' || CAST(p_partkey % 4 AS STRING) ELSE '' END AS vendor,
  CASE WHEN p_partkey % 5 = 2 THEN 'npm' ELSE '' END AS ecosystem, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE 'pkg' || CAST(p_partkey AS STRING) END AS name FROM {0}"""


@query(f"""
WITH q AS ({ASKED.format("part")}
), h AS (
  SELECT DISTINCT q.purl AS result_key, vuln_id FROM q JOIN affected a ON a.purl = q.purl WHERE q.purl <> ''
  UNION SELECT q.vendor || '/' || q.name, vuln_id FROM q JOIN affected a ON a.vendor = q.vendor AND a.package_name = q.name WHERE q.purl = '' AND q.vendor <> '' AND q.name <> ''
  UNION SELECT q.ecosystem || ':' || q.name, vuln_id FROM q JOIN affected a ON a.ecosystem = q.ecosystem AND a.package_name = q.name WHERE q.purl = '' AND q.vendor = '' AND q.ecosystem <> '' AND q.name <> ''
  UNION SELECT q.name, vuln_id FROM q JOIN affected a ON a.package_name = q.name WHERE q.purl = '' AND q.vendor = '' AND q.ecosystem = '' AND q.name <> '')
SELECT result_key, vuln_id FROM (SELECT *, row_number() OVER (PARTITION BY result_key ORDER BY vuln_id) AS n FROM h) WHERE n <= 20
""")
def batch_query_affected(spark, sf_dir):
    t = Tables(spark, sf_dir)
    asked = spark.sql(ASKED.format("{part}"), part=t.part)
    return lookups.batch_query_affected(t.affected, asked, 20)


@query("SELECT DISTINCT lower(package_name) AS name FROM affected WHERE package_name <> ''")
def vuln_name_index(spark, sf_dir):
    return lookups.vuln_name_index(Tables(spark, sf_dir).affected)


@query("""
SELECT DISTINCT id, related_id FROM (
  SELECT v.alias AS id, v.id AS related_id FROM vulnerabilities v UNION ALL SELECT v.id, v.alias FROM vulnerabilities v WHERE v.alias IN (SELECT id FROM vulnerabilities)) WHERE id <> related_id
""")
def alias_related(spark, sf_dir):
    return lookups.related(vulnerabilities(Tables(spark, sf_dir)))


@query("""
WITH q AS (SELECT 'CVE-2024-' || CAST(o_orderkey AS STRING) AS asked FROM orders), r AS (
  SELECT asked, v.id, 0 AS tier FROM q JOIN vulnerabilities v ON v.id = asked UNION ALL SELECT asked, v.id, 1 FROM q JOIN vulnerabilities v ON v.alias = asked WHERE v.id <> asked
  UNION ALL SELECT asked, w.id, 1 FROM q JOIN vulnerabilities v ON v.id = asked JOIN vulnerabilities w ON w.id = v.alias WHERE w.id <> asked)
SELECT asked, id FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY tier, id) AS n FROM r) WHERE n = 1
""")
def get_vulnerability(spark, sf_dir):
    t = Tables(spark, sf_dir)
    asked = t.orders.select(F.concat(F.lit("CVE-2024-"), "o_orderkey").alias("asked"))
    return lookups.get_vulnerability(vulnerabilities(t), asked).select("asked", "id")


@query("""
WITH ids AS (SELECT o_custkey AS pos, 'CVE-2024-' || CAST(o_orderkey % 500 AS STRING) AS id FROM orders), n AS (SELECT vuln_id, count(*) AS n_affected FROM affected GROUP BY vuln_id)
SELECT pos, ids.id AS id, summary, coalesce(n_affected, 0) AS n_affected FROM ids JOIN vulnerabilities USING (id) LEFT JOIN n ON n.vuln_id = id
""")
def batch_get(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ids = t.orders.select(F.col("o_custkey").alias("pos"), F.concat(F.lit("CVE-2024-"), (F.col("o_orderkey") % 500).cast("string")).alias("id"))
    n_affected = F.greatest(F.coalesce(F.size("affected"), F.lit(0)), F.lit(0)).cast("long").alias("n_affected")
    return lookups.batch_get(vulnerabilities(t), t.affected, ids, ["pos", "id", "summary", n_affected])


@query("""
WITH r AS (SELECT id, updated_at FROM vulnerabilities WHERE modified >= TIMESTAMP '1997-01-01 00:00:00')
SELECT id, updated_at, (SELECT count(*) FROM r) AS total FROM r ORDER BY updated_at DESC NULLS LAST, id LIMIT 200 OFFSET 100
""")
def changelog_page(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return lookups.changelog(vulnerabilities(t), modified_since=ts("1997-01-01 00:00:00"), limit=200, offset=100).select("id", "updated_at", "total")


@query("SELECT image_id, name, created_at, (SELECT count(*) FROM images) AS total FROM images ORDER BY created_at DESC, image_id LIMIT 10")
def newest_images(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return lookups.newest_images(t.images).crossJoin(F.broadcast(t.images.agg(F.count("*").alias("total"))))


@query("""
SELECT *, total > 90 AS has_more FROM (SELECT *, (SELECT count(*) FROM images) AS total FROM images ORDER BY created_at DESC, image_id LIMIT 50 OFFSET 40)
""")
def list_images(spark, sf_dir):
    return lookups.list_images(Tables(spark, sf_dir).images, 50, 40)


@query("""
SELECT source_package, vuln_id, status, updated_at, (SELECT count(*) FROM advisories WHERE status = 'affected') AS total FROM advisories WHERE status = 'affected'
ORDER BY updated_at DESC, source_package, vuln_id LIMIT 300
""")
def list_advisories(spark, sf_dir):
    return lookups.list_advisories(Tables(spark, sf_dir).advisories, status="affected", limit=300).select("source_package", "vuln_id", "status", "updated_at", "total")


@query("""
SELECT source_package, vuln_id, status FROM (SELECT *, row_number() OVER (PARTITION BY source_package ORDER BY updated_at DESC, vuln_id) AS n FROM advisories WHERE status <> 'detected') WHERE n <= 10
""")
def prior_decisions(spark, sf_dir):
    return lookups.prior_decisions(Tables(spark, sf_dir).advisories).select("source_package", "vuln_id", "status")


@query("""
SELECT source_package, vuln_id FROM (SELECT *, row_number() OVER (PARTITION BY source_package ORDER BY cvss DESC, coalesce(epss, 0) DESC, vuln_id) AS n FROM advisories WHERE status = 'detected') WHERE n <= 5
""")
def review_queue(spark, sf_dir):
    return lookups.review_queue(Tables(spark, sf_dir).advisories, 5).select("source_package", "vuln_id")


@query("SELECT scan_id, severity, vuln_id, package_name FROM findings WHERE lower(severity) = 'high'")
def list_findings(spark, sf_dir):
    return lookups.list_findings(Tables(spark, sf_dir).findings, "high").select("scan_id", "severity", "vuln_id", "package_name")


@query("""
WITH s AS (SELECT scan_id, 'sha' || CAST(platform_id % 40 AS STRING) || '|linux/amd64' AS platform_id FROM scans) SELECT scan_id, platform_id FROM s WHERE platform_id LIKE 'sha1|%' OR platform_id LIKE 'sha2|%'
""")
def scans_by_image(spark, sf_dir):
    t = Tables(spark, sf_dir)
    scans = t.scans.select("scan_id", F.concat(F.lit("sha"), (F.col("platform_id") % 40).cast("string"), F.lit("|linux/amd64")).alias("platform_id"))
    digests = t.region.filter("r_regionkey in (1, 2)").select(F.concat(F.lit("sha"), "r_regionkey").alias("digest"))
    return lookups.scans_by_image(scans, digests).select("scan_id", "platform_id")


@query("SELECT queue, key, priority, status FROM items WHERE status = 'pending' ORDER BY priority DESC, created_at, queue, key LIMIT 100 OFFSET 50")
def list_items(spark, sf_dir):
    return lookups.list_items(Tables(spark, sf_dir).items, "pending", 100, 50).select("queue", "key", "priority", "status")


@query("""
SELECT queue, key, string_agg(CAST(id AS STRING), ',' ORDER BY created_at DESC, id DESC) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY queue, key ORDER BY created_at DESC, id DESC) AS n FROM history) WHERE n <= 20 GROUP BY queue, key
""")
def item_history(spark, sf_dir):
    h = Tables(spark, sf_dir).history
    got = lookups.item_history(h.select("queue", "key").distinct(), h, 20)
    return got.select("queue", "key", F.array_join(F.transform("history", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("SELECT scan_id, platform_id, scanner, vuln_id, severity FROM findings JOIN (SELECT *, rank() OVER (PARTITION BY platform_id, scanner ORDER BY completed_at DESC) AS n FROM scans) USING (scan_id) WHERE n = 1")
def latest_findings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return joins.latest_findings(t.scans, t.findings).select("scan_id", "platform_id", "scanner", "vuln_id", "severity")


@query("SELECT scan_id, platform_id, scanner FROM (SELECT *, row_number() OVER (PARTITION BY platform_id, scanner ORDER BY completed_at DESC, scan_id) AS n FROM scans) WHERE n = 1")
def latest_per_key(spark, sf_dir):
    return joins.latest_scan(Tables(spark, sf_dir).scans).select("scan_id", "platform_id", "scanner")


TAGS = "SELECT o_custkey AS image_id, o_orderdate AS tagged_at, o_orderkey % 2 = 0 AS current FROM {0}"


@query(f"""
WITH tags AS ({TAGS.format("orders")}), wanted AS (
  SELECT image_id FROM tags WHERE current AND tagged_at > TIMESTAMP '1998-07-01 00:00:00' - INTERVAL 30 DAY UNION SELECT image_id FROM (SELECT image_id FROM images ORDER BY created_at DESC, image_id LIMIT 10)),
done AS (SELECT platform_id FROM (SELECT *, row_number() OVER (PARTITION BY platform_id ORDER BY completed_at DESC, scan_id) AS n FROM scans WHERE scanner = 'view') WHERE n = 1 AND status = 'completed' AND db_version = 'v1')
SELECT platform_id, image_id FROM platforms WHERE image_id IN (SELECT image_id FROM wanted) AND platform_id IN (SELECT platform_id FROM sboms) AND platform_id NOT IN (SELECT platform_id FROM done)
""")
def worklist_scan(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tags = spark.sql(TAGS.format("{orders}"), orders=t.orders)
    return joins.platforms_needing_scan(t.images, tags, t.platforms, t.sboms, t.scans, "view", "v1", ts("1998-07-01 00:00:00"))


@query(f"""
WITH tags AS ({TAGS.format("orders")})
SELECT DISTINCT 'grype|' || CAST(platform_id AS STRING) AS key FROM platforms WHERE image_id IN (SELECT image_id FROM tags WHERE current AND tagged_at > TIMESTAMP '1998-07-01 00:00:00' - INTERVAL 30 DAY) ORDER BY key LIMIT 1000
""")
def worklist_rescan(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return joins.rescan_worklist(spark.sql(TAGS.format("{orders}"), orders=t.orders), t.platforms, ts("1998-07-01 00:00:00"))


@query("SELECT source_package, upstream_version, rpm_version FROM sources WHERE source_package NOT IN (SELECT source_package FROM advisories) AND source_package NOT IN (SELECT rpm_name FROM mappings)")
def worklist_unmatched(spark, sf_dir):
    t = Tables(spark, sf_dir)
    state = t.advisories.select("source_package").union(t.mappings.select("rpm_name"))
    return joins.unmatched_packages(t.sources, state)


@query("""
SELECT id, summary, date_added, score, coalesce(n_notes, 0) AS n_notes, note_vendors, date_added IS NOT NULL AS in_kev FROM (SELECT *, CASE WHEN id LIKE 'CVE-%' THEN id WHEN alias LIKE 'CVE-%' THEN alias ELSE id END AS cve FROM vulnerabilities) v
LEFT JOIN kev ON kev.cve_id = cve LEFT JOIN epss ON epss.cve_id = cve LEFT JOIN (SELECT cve_id, count(*) AS n_notes, string_agg(DISTINCT vendor, ',' ORDER BY vendor) AS note_vendors FROM notes GROUP BY cve_id) n ON n.cve_id = cve
""")
def enrich_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return joins.enrich(vulnerabilities(t), t.kev, t.epss, t.notes).select("id", "summary", "date_added", "score", "n_notes", "note_vendors", "in_kev")


@query("""
SELECT source_package, vuln_id, n_entries, first_source FROM advisories LEFT JOIN (SELECT vuln_id, count(*) AS n_entries, min(source) AS first_source FROM affected GROUP BY vuln_id) USING (vuln_id)
""")
def review_evidence(spark, sf_dir):
    t = Tables(spark, sf_dir)
    v = vulnerabilities(t).withColumn("details", F.lit("")).withColumn("severity", F.array().cast("array<struct<type:string,score:string>>"))
    out = joins.review_evidence(t.advisories, v, t.affected)
    return out.select("source_package", "vuln_id", F.size("entries").cast("long").alias("n_entries"), F.get("entries", F.lit(0))["source"].alias("first_source")).withColumn("n_entries", F.when(F.col("n_entries") >= 0, F.col("n_entries")))


LEASES = "SELECT queue, key, updated_at AS lease_expires FROM {0} WHERE status IN ('claimed', 'running')"


@query(f"WITH l AS ({LEASES.format('items')}) SELECT queue, key, status, lease_expires FROM l JOIN items USING (queue, key) WHERE lease_expires < TIMESTAMP '1996-01-01 00:00:00'")
def expired_leases(spark, sf_dir):
    t = Tables(spark, sf_dir)
    items = t.items
    return joins.expired_leases(items, spark.sql(LEASES.format("{items}"), items=items), ts("1996-01-01 00:00:00")).select("queue", "key", "status", "lease_expires")


# Reports


@query("""
SELECT scan_id % 100 AS platform, count(*) AS total, count(*) FILTER (lower(severity) = 'critical') AS n_critical, count(*) FILTER (lower(severity) = 'high') AS n_high,
  count(*) FILTER (lower(severity) = 'medium') AS n_medium, count(*) FILTER (lower(severity) = 'low') AS n_low FROM findings GROUP BY scan_id % 100
""")
def severity_rollup(spark, sf_dir):
    return agg.severity_rollup(Tables(spark, sf_dir).findings.withColumn("platform", F.col("scan_id") % 100), "platform")


@query("SELECT queue, status, count(*) AS n FROM items GROUP BY queue, status")
def count_by_status(spark, sf_dir):
    return agg.count_by_status(Tables(spark, sf_dir).items)


@query("""
WITH c AS (SELECT queue, status, count(*) AS n FROM items GROUP BY queue, status)
SELECT 'q' || CAST(r_regionkey * 2 AS STRING) AS queue, coalesce((SELECT string_agg(status || '=' || CAST(n AS STRING), ',' ORDER BY status) FROM c WHERE c.queue = 'q' || CAST(r_regionkey * 2 AS STRING)), '') AS counts,
  CAST(coalesce((SELECT sum(n) FROM c WHERE c.queue = 'q' || CAST(r_regionkey * 2 AS STRING)), 0) AS BIGINT) AS total FROM region
""")
def queue_overview(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = agg.queue_overview(t.items, t.region.select(F.concat(F.lit("q"), (F.col("r_regionkey") * 2).cast("string")).alias("queue")))
    shown = F.array_join(F.transform(F.sort_array(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.select("queue", shown.alias("counts"), "total")


OURS = "SELECT vuln_id, 'pkg' || CAST(length(notes) % 13 AS STRING) AS package_name, status = 'affected' AS affected FROM {0}"
THEIRS = "SELECT 'CVE-2024-' || CAST(scan_id % 97 AS STRING) AS vuln_id, package_name FROM {0}"


@query(f"""
WITH o AS (SELECT vuln_id, package_name, bool_or(affected) AS yes FROM ({OURS.format("advisories")}) GROUP BY 1, 2), f AS (SELECT DISTINCT vuln_id, package_name, true AS told FROM ({THEIRS.format("findings")})),
b AS (SELECT coalesce(yes, false) AS yes, yes IS NOT NULL AS ours, coalesce(told, false) AS told FROM o FULL JOIN f USING (vuln_id, package_name)),
n AS (SELECT count(*) FILTER (yes AND told) AS "both", count(*) FILTER (yes AND NOT told) AS only_ours, count(*) FILTER (NOT yes AND told) AS only_theirs, count(*) FILTER (told AND ours AND NOT yes) AS we_say_not_affected FROM b)
SELECT *, round("both" / ("both" + only_theirs), 9) AS recall, round("both" / ("both" + only_ours), 9) AS precision FROM n
""")
def accuracy_report(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ours, theirs = spark.sql(OURS.format("{a}"), a=t.advisories), spark.sql(THEIRS.format("{f}"), f=t.findings)
    return agg.accuracy_report(ours, theirs).withColumn("recall", F.round("recall", 9)).withColumn("precision", F.round("precision", 9))


@query(f"""
WITH o AS ({OURS.format("advisories")}), m AS (SELECT DISTINCT vuln_id, package_name FROM ({THEIRS.format("findings")}) EXCEPT SELECT vuln_id, package_name FROM o)
SELECT CASE WHEN vuln_id IN (SELECT vuln_id FROM o) THEN 'cve-matched-different-pkg' ELSE 'cve-not-found' END AS reason, count(*) AS n FROM m GROUP BY 1
""")
def miss_reasons(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return agg.miss_reasons(spark.sql(OURS.format("{a}"), a=t.advisories), spark.sql(THEIRS.format("{f}"), f=t.findings))


@query("""
SELECT source_package, count(*) FILTER (status = 'detected') AS detected, count(*) FILTER (status = 'not-affected') AS not_affected, count(*) AS total,
  count(*) FILTER (confidence = 'high') AS confidence_high, count(*) FILTER (confidence = 'medium') AS confidence_medium, count(*) FILTER (confidence = 'low') AS confidence_low FROM advisories GROUP BY source_package
""")
def advisory_summary(spark, sf_dir):
    return agg.advisory_summary(Tables(spark, sf_dir).advisories)


@query(f"""
WITH o AS (SELECT DISTINCT vuln_id, package_name FROM ({OURS.format("advisories")})), f AS (SELECT DISTINCT vuln_id, package_name FROM ({THEIRS.format("findings")}))
SELECT vuln_id, package_name, 'both' AS side FROM (SELECT * FROM o INTERSECT SELECT * FROM f) UNION ALL SELECT vuln_id, package_name, 'left' FROM (SELECT * FROM o EXCEPT SELECT * FROM f)
UNION ALL SELECT vuln_id, package_name, 'right' FROM (SELECT * FROM f EXCEPT SELECT * FROM o)
""")
def set_compare(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return lookups.set_compare(spark.sql(OURS.format("{a}"), a=t.advisories), spark.sql(THEIRS.format("{f}"), f=t.findings), ["vuln_id", "package_name"])


EDGES = (1, 5, 10, 30, 60, 100)


@query(f"""
SELECT queue, le, CASE WHEN le IS NULL THEN count(*) ELSE count(*) FILTER (duration <= le) END AS n, round(sum(duration), 4) AS sum FROM history CROSS JOIN (VALUES {", ".join(f"({float(e)})" for e in EDGES)}, (CAST(NULL AS DOUBLE))) AS b(le) GROUP BY queue, le
""")
def latency_histogram(spark, sf_dir):
    return agg.latency_histogram(Tables(spark, sf_dir).history, ["queue"], "duration", EDGES).withColumn("sum", F.round("sum", 4))


@query("SELECT queue, to_status, round(quantile_cont(duration, 0.5), 6) AS p50, round(quantile_cont(duration, 0.9), 6) AS p90, round(quantile_cont(duration, 0.99), 6) AS p99 FROM history GROUP BY queue, to_status")
def latency_quantiles(spark, sf_dir):
    out = agg.latency_quantiles(Tables(spark, sf_dir).history, ["queue", "to_status"], "duration", exact=True)
    return out.select("queue", "to_status", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")])


@query("""
SELECT queue, date_trunc('day', ts) AS day, count(duration) AS n, min(duration) AS least, max(duration) AS most, true AS p50_fits, true AS p99_fits FROM history WHERE duration IS NOT NULL GROUP BY queue, 2
""")
def daily_quantiles(spark, sf_dir):
    """Day figures merged from hourly sketches; of the quantiles, whether their ranks are within the error that is stated."""
    h = Tables(spark, sf_dir).history.withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    daily = sketches.sketch_quantiles(sketches.roll_up(sketches.quantile_sketches(h, ["queue"], "duration"), ["queue"], "1 day"))
    daily = daily.withColumn("day", F.col("window_start").cast("timestamp_ntz"))
    ranks = h.filter("duration is not null").select("queue", "day", "duration").join(daily.select("queue", "day", "p50", "p99"), ["queue", "day"]).groupBy("queue", "day")
    near = lambda c, p: (F.avg((F.col("duration") < F.col(c)).cast("int")) - sketches.RANK_ERROR <= p) & (F.avg((F.col("duration") <= F.col(c)).cast("int")) + sketches.RANK_ERROR >= p)
    return daily.select("queue", "day", "n", "least", "most").join(ranks.agg(near("p50", 0.5).alias("p50_fits"), near("p99", 0.99).alias("p99_fits")), ["queue", "day"])


@query("""
SELECT queue, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status IN ('claimed', 'running')) AS in_progress, count(*) FILTER (status = 'dead_letter') AS dead_letters,
  CAST(coalesce(epoch(TIMESTAMP '2000-01-01 00:00:00') - epoch(min(CASE WHEN status = 'pending' THEN created_at END)), 0) AS BIGINT) AS oldest_pending_s FROM items GROUP BY queue
""")
def queue_gauges(spark, sf_dir):
    return agg.queue_gauges(Tables(spark, sf_dir).items, ts("2000-01-01 00:00:00"))


@query("""
SELECT image, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures, max(CASE WHEN success THEN ts END) AS last_success, arg_max(size, ts) FILTER (success) AS last_size,
  arg_max(success, ts) AS up, count(*) FILTER (duration <= 5) AS le_5, count(*) FILTER (duration <= 60) AS le_60 FROM probes GROUP BY image
""")
def probe_metrics(spark, sf_dir):
    return agg.probe_metrics(Tables(spark, sf_dir).probes).select("image", "successes", "failures", "last_success", "last_size", "up", "le_5", "le_60")


CASES = "SELECT doc_id AS case_id, CASE WHEN quality = 1 THEN 'affected' ELSE 'not-affected' END AS status FROM {0}"
JUDGED = "SELECT doc_id AS case_id, CASE WHEN n_chars > 900 THEN 'affected' WHEN n_chars > 300 THEN 'not-affected' ELSE 'under-review' END AS status FROM {0}"


@query(f"WITH l AS ({CASES.format('labels')}), a AS ({JUDGED.format('documents')}) SELECT count(*) AS cases, count(*) FILTER (l.status = a.status) AS \"right\", round(count(*) FILTER (l.status = a.status) / count(*), 9) AS accuracy FROM l JOIN a USING (case_id)")
def assessment_accuracy(spark, sf_dir):
    t = Tables(spark, sf_dir)
    report, _ = agg.assessment_accuracy(spark.sql(JUDGED.format("{d}"), d=t.documents), spark.sql(CASES.format("{l}"), l=t.labels))
    return report.withColumn("accuracy", F.round("accuracy", 9))


@query(f"WITH l AS ({CASES.format('labels')}), a AS ({JUDGED.format('documents')}) SELECT case_id FROM l JOIN a USING (case_id) WHERE l.status = 'affected' AND a.status = 'not-affected'")
def assessment_false_negatives(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return agg.assessment_accuracy(spark.sql(JUDGED.format("{d}"), d=t.documents), spark.sql(CASES.format("{l}"), l=t.labels))[1]


# Histories and the work log


@query("""
WITH c AS (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT * FROM c WHERE n = 1 OR before <> event_type)
SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS current FROM k
""")
def scd2_history(spark, sf_dir):
    return windows.tag_history(Tables(spark, sf_dir).events, ["user_id"], "event_type")


@query()
def scd2_history_on_file(spark, sf_dir):
    """The same history from three batches: the events out of order, a part of them again, and others that are taken back before they come."""
    events = Tables(spark, sf_dir).events.select("user_id", "event_id", "ts", "event_type")
    h = history.History(bucketed.scratch_path(spark, "history"), ("user_id",), "event_type")
    history.create_history(h, events.filter("event_id % 3 = 1"), buckets=8)
    extra = events.filter("event_id % 5 = 0").withColumn("event_id", F.col("event_id") + 1_000_000_000)
    none = [F.lit(None).cast(t).alias(c) for c, t in events.dtypes if c in ("ts", "event_type")]
    history.apply_events(spark, h, extra.select("user_id", "event_id", *none, F.lit(True).alias("retracted")))
    history.apply_events(spark, h, events.filter("event_id % 3 != 1 or event_id % 7 = 0").unionByName(extra))
    return history.read_history(spark, h)


ORACLES["scd2_history_on_file"] = ORACLES["scd2_history"]


@query("SELECT queue, key, id, to_status AS status, round(epoch_us(lead(created_at) OVER (PARTITION BY queue, key ORDER BY created_at, id)) / 1e6 - epoch_us(created_at) / 1e6, 3) AS seconds FROM history")
def time_in_state(spark, sf_dir):
    h = Tables(spark, sf_dir).history.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return windows.time_in_state(h).withColumn("seconds", F.round("seconds", 3))


@query("SELECT queue, key, id, to_status FROM (SELECT *, row_number() OVER (PARTITION BY queue, key ORDER BY created_at DESC, id DESC) AS n FROM history) WHERE n = 1")
def current_state(spark, sf_dir):
    return windows.current_state(Tables(spark, sf_dir).history).select("queue", "key", "id", "to_status")


@query("""
WITH busy AS (SELECT queue, count(*) AS n FROM items WHERE status IN ('claimed', 'running') GROUP BY queue),
r AS (SELECT queue, key, row_number() OVER (PARTITION BY queue ORDER BY priority DESC, created_at, key) AS rank FROM items WHERE status = 'pending')
SELECT queue, key, rank FROM r LEFT JOIN busy USING (queue) WHERE rank <= greatest(0, least(25, 900 - coalesce(n, 0)))
""")
def budgeted_top_k(spark, sf_dir):
    items = Tables(spark, sf_dir).items.withColumn("not_before", F.lit(None).cast("timestamp_ntz"))
    busy = items.filter("status in ('claimed', 'running')").groupBy("queue").agg(F.count("*").alias("n"))
    return windows.budgeted_top_k(items, busy, 900, ts("2000-01-01 00:00:00"), 25).select("queue", "key", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT a.status AS a, b.status AS b, (a.status, b.status) IN (('pending', 'claimed'), ('pending', 'failed'), ('claimed', 'running'), ('claimed', 'failed'), ('claimed', 'pending'), ('running', 'succeeded'), ('running', 'failed'), ('running', 'pending'),
  ('failed', 'pending'), ('failed', 'dead_letter'), ('dead_letter', 'pending')) AS valid FROM (SELECT DISTINCT status FROM items) a, (SELECT DISTINCT status FROM items) b
""")
def valid_transitions(spark, sf_dir):
    s = Tables(spark, sf_dir).items.select("status").distinct()
    pairs = s.select(F.col("status").alias("a")).crossJoin(F.broadcast(s.select(F.col("status").alias("b"))))  # six states
    return pairs.withColumn("valid", is_valid_transition("a", "b"))


@query("SELECT queue, key, status, updated_at FROM items WHERE NOT (status IN ('succeeded', 'failed') AND updated_at < TIMESTAMP '1998-01-08 00:00:00' - INTERVAL 7 DAY) AND status <> 'dead_letter'")
def retention(spark, sf_dir):
    return merge.retain(Tables(spark, sf_dir).items, ts("1998-01-08 00:00:00"), purge_dead=True).select("queue", "key", "status", "updated_at")


@query("""
SELECT queue, key, 'not in pending set' AS problem FROM items WHERE status = 'pending' AND priority = 5 UNION ALL SELECT queue, key, 'not pending' FROM items WHERE status = 'succeeded' AND priority < 5
UNION ALL SELECT queue, key, 'lease without work' FROM items WHERE status = 'failed' AND priority = 1
""")
def queue_inconsistencies(spark, sf_dir):
    items = Tables(spark, sf_dir).items
    return merge.queue_inconsistencies(items, items.filter("status in ('pending', 'succeeded') and priority < 5"), items.filter("status in ('claimed', 'running') or (status = 'failed' and priority = 1)"))


RESPONSES = """
SELECT queue, key, id, attempts, attempts + 1 AS priority, CASE WHEN to_status = 'pending' THEN 'requeue' WHEN to_status = 'claimed' THEN 'fan_out' WHEN to_status = 'succeeded' THEN 'completed' WHEN to_status = 'running' THEN 'odd' ELSE 'reject' END AS action,
  CASE WHEN id % 11 = 0 THEN 'boom' ELSE '' END AS error FROM {0}
"""


@query(f"""
WITH r AS ({RESPONSES.format("history")})
SELECT id, CASE WHEN action = 'reject' THEN 'dead_letter' WHEN (error <> '' OR action = 'odd') AND attempts >= 5 THEN 'dead_letter' WHEN error <> '' OR action = 'odd' THEN 'pending' WHEN action = 'requeue' THEN 'pending' ELSE 'succeeded' END AS status,
  CASE WHEN action = 'reject' THEN NULL WHEN (error <> '' OR action = 'odd') AND attempts < 5 THEN least(3600, 10 * pow(2, greatest(attempts, 1) - 1)) WHEN error <> '' OR action = 'odd' THEN NULL WHEN action = 'requeue' THEN 30 END AS delay_s,
  CASE WHEN action = 'requeue' AND error = '' THEN greatest(0, attempts - 1) ELSE attempts END AS attempts FROM r
""")
def outcome_disposition(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = spark.sql(RESPONSES.format("{h}"), h=t.history).withColumn("requeue_after", F.lit(None).cast("double")).withColumn("fan_out_keys", F.array("key"))
    rows = rows.withColumn("key", F.col("id"))
    return worklog.outcome_disposition(rows)[0].select(F.col("key").alias("id"), "status", "delay_s", "attempts")


@query("""
SELECT queue, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, count(*) AS n, round(quantile_cont(duration, 0.99), 6) AS p99_s, quantile_cont(attempts, 0.5) > 2 AS alert_attempts, count(*) FILTER (to_status = 'pending') AS pending,
  count(*) FILTER (to_status = 'pending') > 8 AS alert_backlog, quantile_cont(duration, 0.99) > 150 AS alert_slow FROM history GROUP BY 1, 2
""")
def alert_windows(spark, sf_dir):
    out = worklog.alert_rules(Tables(spark, sf_dir).history, "6 hours", exact=True, limits={"attempts": 2, "pending": 8, "p99_s": 150})
    return out.select("queue", "window_start", "n", F.round("p99_s", 6).alias("p99_s"), "alert_attempts", "pending", "alert_backlog", "alert_slow")


@query("SELECT image, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS probes, count(*) FILTER (success) AS ok, round(count(*) FILTER (success) / count(*), 9) AS availability FROM probes GROUP BY 1, 2")
def probe_windows(spark, sf_dir):
    out = worklog.probe_windows(Tables(spark, sf_dir).probes, "1 day")
    return out.select("image", "window_start", "probes", "ok", F.round("availability", 9).alias("availability"))


REQUESTS = "SELECT id AS event_id, ts, queue, key, CASE WHEN to_status IN ('pending', 'claimed', 'running') AND id % 2 = 0 THEN 'request' ELSE to_status END AS kind, CAST(attempts AS INT) AS priority, ts AS not_before FROM {0}"


@query(f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY queue, key ORDER BY ts, event_id) AS n FROM ({REQUESTS.format("history")})),
f AS (SELECT queue, key, n, CASE WHEN kind = 'request' THEN 'pending' ELSE kind END AS status, priority, CAST(kind = 'claimed' AS INT) AS attempts, not_before, CAST(kind = 'request' AS BIGINT) AS requests FROM o WHERE n = 1
UNION ALL SELECT o.queue, o.key, o.n, CASE WHEN kind <> 'request' THEN kind WHEN status IN ('succeeded', 'failed', 'dead_letter') THEN 'pending' ELSE status END,
  CASE WHEN kind = 'request' AND status = 'pending' THEN greatest(f.priority, o.priority) WHEN kind = 'request' AND status IN ('succeeded', 'failed', 'dead_letter') THEN o.priority ELSE f.priority END,
  CASE WHEN kind = 'request' AND status IN ('succeeded', 'failed', 'dead_letter') THEN 0 ELSE attempts + CAST(kind = 'claimed' AS INT) END,
  CASE WHEN kind = 'request' AND status IN ('pending', 'succeeded', 'failed', 'dead_letter') THEN o.not_before ELSE f.not_before END,
  requests + CAST(kind = 'request' AND status IN ('pending', 'succeeded', 'failed', 'dead_letter') AS BIGINT)
  FROM f JOIN o ON o.queue = f.queue AND o.key = f.key AND o.n = f.n + 1)
SELECT queue, key, status, priority, attempts, not_before, requests FROM f QUALIFY row_number() OVER (PARTITION BY queue, key ORDER BY n DESC) = 1
""")
def fold_requests(spark, sf_dir):
    return worklog.fold_requests(spark.sql(REQUESTS.format("{h}"), h=Tables(spark, sf_dir).history)).withColumn("not_before", F.col("not_before").cast("timestamp_ntz"))


@query("""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY queue, key ORDER BY ts, id) AS n FROM history),
f AS (SELECT queue, key, n, CASE WHEN to_status = 'pending' THEN 'pending' END AS status, CAST(to_status = 'pending' AS BIGINT) AS accepted, CAST(to_status <> 'pending' AS BIGINT) AS rejected FROM o WHERE n = 1
UNION ALL SELECT queue, key, n, CASE WHEN ok THEN to_status ELSE status END, accepted + CAST(ok AS BIGINT), rejected + CAST(NOT ok AS BIGINT) FROM (
  SELECT o.queue, o.key, o.n, o.to_status, f.status, f.accepted, f.rejected, (f.status IS NULL AND o.to_status = 'pending') OR coalesce((f.status, o.to_status) IN (('pending', 'claimed'), ('pending', 'failed'), ('claimed', 'running'),
    ('claimed', 'failed'), ('claimed', 'pending'), ('running', 'succeeded'), ('running', 'failed'), ('running', 'pending'), ('failed', 'pending'), ('failed', 'dead_letter'), ('dead_letter', 'pending')), false) AS ok
  FROM f JOIN o ON o.queue = f.queue AND o.key = f.key AND o.n = f.n + 1))
SELECT queue, key, status, accepted, rejected FROM f QUALIFY row_number() OVER (PARTITION BY queue, key ORDER BY n DESC) = 1
""")
def replay_lifecycle(spark, sf_dir):
    h = Tables(spark, sf_dir).history
    return worklog.replay_lifecycle(h.withColumnRenamed("id", "event_id"))


@query()
def replay_lifecycle_stream(spark, sf_dir):
    """The same as a stream over the events' file, with an event far ahead that moves the watermark past all others; the last state of each key."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = bucketed.scratch_path(spark, "stream")
    ahead = events.agg(*[(F.max(c) + F.expr("interval 30 days") if c == "ts" else F.max(c)).alias(c) for c in events.columns])
    events.write.parquet(f"{path}/in/events")
    ahead.withColumn("user_id", F.lit(-1).cast(events.schema["user_id"].dataType)).write.parquet(f"{path}/in/ahead")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(f"{path}/in")
    history = spark.sql(STANDINS["history"].replace("FROM events", "FROM {e}"), e=stream).withColumnRenamed("id", "event_id")
    states = ordered.ordered_fold_stream(history.withColumns({"kind": F.lit("request"), "priority": F.lit(0), "not_before": F.col("ts")}), "lifecycle", retention_s=36_500 * 86_400)
    # A batch that is written twice overwrites itself.
    write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/out/{n}")
    query = states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.option("recursiveFileLookup", True).schema("queue string, key string, status string, accepted long, rejected long, batch long").parquet(f"{path}/out")
    last = out.groupBy("queue", "key").agg(F.max_by(F.struct("status", "accepted", "rejected"), "batch").alias("s"))
    return last.filter("key != 'k-1'").select("queue", "key", "s.*")


ORACLES["replay_lifecycle_stream"] = ORACLES["replay_lifecycle"]


@query("""
SELECT queue, key, max_by(ts, (ts, id)) + INTERVAL 3600 SECOND AS expired_at FROM history GROUP BY queue, key
HAVING max_by(to_status, (ts, id)) IN ('claimed', 'running') AND max_by(ts, (ts, id)) + INTERVAL 3600 SECOND < TIMESTAMP '2024-01-30 12:00:00'
""")
def lease_expiry(spark, sf_dir):
    h = Tables(spark, sf_dir).history.select("queue", "key", F.col("id").alias("event_id"), "ts", F.col("to_status").alias("kind"), F.lit("w").alias("worker_id"))
    return worklog.lease_expiry(h, 3600, ts("2024-01-30 12:00:00")).select("queue", "key", "expired_at")


@query("SELECT key, to_status, ts FROM history WHERE queue = 'q1'")
def event_feed(spark, sf_dir):
    return worklog.event_feed(Tables(spark, sf_dir).history, "q1")


NOW, PERIOD, TICK = 1_700_000_000, 86_400, 3_600


def _fnv_oracle(queue: str) -> str:
    """FNV-1a over each key's bytes, after those of the queue and of the period's start."""
    start, tick = (NOW - (NOW + 62_135_596_800) % n for n in (PERIOD, TICK))
    h = 0xCBF29CE484222325
    for b in queue.encode() + bytes(1) + start.to_bytes(8, "big"):
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    step = "(xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT"
    return f"""
WITH k AS (SELECT 'key-' || CAST(o_orderkey AS STRING) AS key FROM orders), s AS (
  SELECT key, CAST(list_reduce(list_concat([{h}::UHUGEINT], list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS UHUGEINT))), lambda h, b: {step}) % {PERIOD} AS BIGINT) AS second FROM k)
SELECT key, second, make_timestamp(({tick} + second - {tick - start}) * 1000000) AS not_before, 0 AS priority FROM s WHERE second >= {tick - start} AND second < {tick - start + TICK}
"""


@query(_fnv_oracle("rescan"))
def resync_shard(spark, sf_dir):
    keys = Tables(spark, sf_dir).orders.select(F.concat(F.lit("key-"), "o_orderkey").alias("key"))
    return worklog.resync_shard(keys, "rescan", NOW, PERIOD, TICK).withColumn("not_before", F.col("not_before").cast("timestamp_ntz"))


# Change detection and merges

DELTA = "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal + 1 END AS c_acctbal, c_mktsegment FROM {0} WHERE c_custkey % 3 = 0"


@query("""
WITH old AS (SELECT doc_id AS vuln_id, source, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS raw_hash FROM documents WHERE doc_id % 7 <> 0)
SELECT doc_id AS vuln_id, d.source, sha256(text) AS raw_hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM old WHERE vuln_id = doc_id AND old.source = d.source AND raw_hash = sha256(text))
""")
def changed_by_hash(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    new = d.select(F.col("doc_id").alias("vuln_id"), "source", F.sha2("text", 256).alias("raw_hash"))
    old = d.filter("doc_id % 7 != 0").select(F.col("doc_id").alias("vuln_id"), "source", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("raw_hash"))
    return cdc.changed_records(new, old)


@query("""
WITH n AS (SELECT p_partkey AS cve_id, CAST(p_retailprice / 10000 AS FLOAT) AS score FROM part), o AS (SELECT p_partkey AS cve_id, CAST(p_retailprice / 10000 + CASE WHEN p_partkey % 3 = 0 THEN 0.05 ELSE 0.001 END AS FLOAT) AS old FROM part WHERE p_partkey % 4 <> 0)
SELECT cve_id FROM n LEFT JOIN o USING (cve_id) WHERE old IS NULL OR abs(score - old) > CAST(0.01 AS FLOAT)
""")
def changed_by_delta(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    new = p.select(F.col("p_partkey").alias("cve_id"), (F.col("p_retailprice") / 10000).cast("float").alias("score"))
    old = p.filter("p_partkey % 4 != 0").select(F.col("p_partkey").alias("cve_id"), (F.col("p_retailprice") / 10000 + F.when(F.col("p_partkey") % 3 == 0, 0.05).otherwise(0.001)).cast("float").alias("score"))
    return cdc.epss_changes(new, old).select("cve_id")


@query("SELECT cve_id, date_added FROM kev WHERE cve_id NOT IN (SELECT cve_id FROM epss)")
def kev_changes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return cdc.kev_changes(t.kev, t.epss, True)


@query("SELECT cve_id, vendor FROM notes WHERE vendor <> 'vendor1'")
def note_changes(spark, sf_dir):
    notes = Tables(spark, sf_dir).notes.withColumn("content", F.struct("cve_id", "vendor"))
    hashes = cdc.note_changes(notes.filter("vendor = 'vendor1'"), notes.select("cve_id", "vendor", F.lit("").alias("hash")))[1]
    return cdc.note_changes(notes, hashes)[0].select("cve_id", "vendor")


@query("SELECT 'nvd' AS source, o_orderkey AS part FROM orders WHERE o_orderkey % 10 = 3 OR o_orderkey % 8 = 1 OR o_orderkey % 6 = 5")
def changed_parts(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    listing = o.select(F.lit("nvd").alias("source"), F.col("o_orderkey").alias("part"), F.when(F.col("o_orderkey") % 6 == 5, "").otherwise(F.col("o_orderstatus")).alias("etag"))
    known = o.filter("o_orderkey % 8 != 1").select(F.lit("nvd").alias("source"), F.col("o_orderkey").alias("part"), F.when(F.col("o_orderkey") % 10 == 3, "old").otherwise(F.col("o_orderstatus")).alias("etag"))
    return cdc.changed_parts(listing, known).select("source", "part")


TREE = "SELECT o_orderkey % 7 AS side, o_orderkey AS path, CASE WHEN o_orderkey % 7 = 3 THEN 'u' || CAST(o_custkey AS STRING) ELSE 'h' || CAST(o_custkey % 400 AS STRING) END AS hash FROM {0}"


@query(f"""
WITH t AS ({TREE.format("orders")}), o AS (SELECT CASE WHEN side = 1 THEN path + 1000000000 ELSE path END AS path, CASE WHEN side = 0 THEN hash || 'x' ELSE hash END AS hash FROM t WHERE side NOT IN (2, 3)),
s AS (SELECT o.hash, bool_or(t.hash IS NOT NULL AND t.hash = o.hash) AS stands FROM o LEFT JOIN t USING (path) GROUP BY o.hash)
SELECT t.path, t.hash, CASE WHEN o.hash IS NOT NULL THEN 'modified' WHEN stands THEN 'copied' WHEN stands IS NOT NULL THEN 'renamed' ELSE 'added' END AS change FROM t LEFT JOIN o USING (path) LEFT JOIN s ON s.hash = t.hash WHERE o.hash IS NULL OR o.hash <> t.hash
""")
def tree_changes(spark, sf_dir):
    t = spark.sql(TREE.format("{o}"), o=Tables(spark, sf_dir).orders)
    path = F.when(F.col("side") == 1, F.col("path") + 1_000_000_000).otherwise(F.col("path"))
    old = t.filter("side not in (2, 3)").select(path.alias("path"), F.when(F.col("side") == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")).alias("hash"))
    return cdc.tree_changes(t.select("path", "hash"), old)


@query("SELECT id, updated_at FROM vulnerabilities WHERE updated_at > TIMESTAMP '1998-06-01 00:00:00' ORDER BY updated_at, id LIMIT 5000")
def changed_vulns(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return cdc.changed_vulns(vulnerabilities(t), t.affected, ts("1998-06-01 00:00:00"))


@query("SELECT id, updated_at FROM vulnerabilities WHERE updated_at > TIMESTAMP '1994-06-01 00:00:00' ORDER BY updated_at, id LIMIT 3000 OFFSET 3000")
def changed_vulns_resumed(spark, sf_dir):
    """The second of two capped runs, behind the first one's last row; many ids share a time."""
    t = Tables(spark, sf_dir)
    v, since = vulnerabilities(t), ts("1994-06-01 00:00:00")
    last = cdc.changed_vulns(v, t.affected, since, 3000).orderBy(F.desc("updated_at"), F.desc("id")).first()
    return cdc.changed_vulns(v, t.affected, since, 3000, (last["updated_at"], last["id"]) if last else None)


@query("""
WITH needles AS (SELECT DISTINCT substr(p_name, 1 + p_partkey % 4, 2 + p_partkey % 3) || CAST(p_partkey % 50 AS STRING) AS needle FROM part), names AS (SELECT DISTINCT p_name || CAST(p_partkey % 1000 AS STRING) AS name FROM part)
SELECT needle, name FROM needles JOIN names ON contains(name, needle)
""")
def substring_search(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    k = F.col("p_partkey")
    needles = p.select(F.concat(F.substr("p_name", (1 + k % 4).cast("int"), (2 + k % 3).cast("int")), (k % 50).cast("string")).alias("needle"))
    return ngrams.substring_search(ngrams.build_ngrams(p.select(F.concat("p_name", (k % 1000).cast("string")).alias("name"))), needles)


@query("""
SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 6 <> 0 THEN c_acctbal + 1 WHEN c_custkey % 12 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer
""")
def merge_coalesce(spark, sf_dir):
    c = Tables(spark, sf_dir).customer
    # Every twelfth customer is only in the delta.
    return merge.merge_coalesce(c.filter("c_custkey % 12 != 0"), spark.sql(DELTA.format("{c}"), c=c), ["c_custkey"], ["c_acctbal"])


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal + 1 END ELSE c_acctbal END AS c_acctbal FROM customer
""")
def merge_lww(spark, sf_dir):
    c = Tables(spark, sf_dir).customer.withColumn("seq", F.lit(1))
    delta = spark.sql(DELTA.format("{c}"), c=c.drop("seq")).withColumn("seq", F.lit(2))
    return merge.merge_lww(c, delta, ["c_custkey"], "seq").select("c_custkey", "c_acctbal")


def _merged(target: DataFrame, source: DataFrame, keys: list[str], rule, name: str) -> DataFrame:
    """The target as a bucketed table in the shared folder after one merge of the source."""
    spark = target.sparkSession
    path = bucketed.scratch_path(spark, name)
    bucketed.create_table(target, path, keys, buckets=8)
    bucketed.apply_merge(spark, path, source, rule)
    return bucketed.read_table(spark, path)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal + 1 END ELSE c_acctbal END AS c_acctbal FROM customer
""")
def merge_file_lww(spark, sf_dir):
    c = Tables(spark, sf_dir).customer.withColumn("seq", F.lit(1))
    delta = spark.sql(DELTA.format("{c}"), c=c.drop("seq")).withColumn("seq", F.lit(2))
    return _merged(c, delta, ["c_custkey"], lambda t, s: merge.merge_lww(t, s, ["c_custkey"], "seq"), "lww").select("c_custkey", "c_acctbal")


@query("""
SELECT vuln_id, source, package_name FROM affected WHERE NOT (source = 'osv' AND vuln_id LIKE '%7') UNION ALL SELECT DISTINCT vuln_id, source, 'replaced' FROM affected WHERE source = 'osv' AND vuln_id LIKE '%7'
""")
def merge_file_by_source(spark, sf_dir):
    a = Tables(spark, sf_dir).affected.select("vuln_id", "source", "package_name")
    new = a.filter("source = 'osv' and vuln_id like '%7'").select("vuln_id", "source", F.lit("replaced").alias("package_name")).distinct()
    return _merged(a, new, ["vuln_id", "source"], merge.replace_by_source, "by-source")


@query("""
SELECT vuln_id, source, package_name FROM affected WHERE NOT (source = 'osv' AND vuln_id LIKE '%7') UNION ALL SELECT DISTINCT vuln_id, source, 'replaced' FROM affected WHERE source = 'osv' AND vuln_id LIKE '%7'
""")
def merge_source_scoped(spark, sf_dir):
    a = Tables(spark, sf_dir).affected.select("vuln_id", "source", "package_name")
    new = a.filter("source = 'osv' and vuln_id like '%7'").select("vuln_id", "source", F.lit("replaced").alias("package_name")).distinct()
    return merge.replace_by_source(a, new)


@query("""
SELECT source_package, vuln_id, CASE WHEN status <> 'fixed' AND vuln_id LIKE '%3' THEN 'new' ELSE status END AS status FROM advisories UNION ALL SELECT DISTINCT source_package, 'CVE-new', 'new' FROM advisories WHERE vuln_id LIKE '%3'
""")
def merge_review_guard(spark, sf_dir):
    a = Tables(spark, sf_dir).advisories.select("source_package", "vuln_id", "status", F.when(F.col("status") == "fixed", F.col("updated_at")).alias("reviewed_at"))
    none = F.lit(None).cast(a.schema["reviewed_at"].dataType).alias("reviewed_at")
    hit = a.filter("vuln_id like '%3'")
    new = hit.select("source_package", "vuln_id", F.lit("new").alias("status"), none).unionByName(hit.select("source_package", F.lit("CVE-new").alias("vuln_id"), F.lit("new").alias("status"), none).distinct())
    return merge.merge_unreviewed(a, new).select("source_package", "vuln_id", "status")


@query("SELECT DISTINCT l_orderkey AS platform_id, l_partkey AS package_id FROM lineitem")
def merge_insert_ignore(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").alias("platform_id"), F.col("l_partkey").alias("package_id"))
    return merge.insert_ignore(rows.filter("platform_id % 2 = 0").distinct(), rows, ["platform_id", "package_id"])


@query("""
SELECT 's' || CAST(s_suppkey AS STRING) AS source, CASE WHEN s_suppkey % 3 = 1 THEN 'new' ELSE 'old' END AS checkpoint_value, CAST(CASE WHEN s_suppkey % 3 = 1 THEN s_nationkey + 5 ELSE s_nationkey END AS INT) AS items_synced,
  CASE WHEN s_suppkey % 3 = 2 THEN 'boom' WHEN s_suppkey % 3 = 0 THEN 'before' END AS error_message FROM supplier
""")
def merge_additive(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier
    old = s.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.lit("old").alias("checkpoint_value"), F.col("s_nationkey").alias("items_synced"), F.lit("before").alias("error_message"))
    new = s.filter("s_suppkey % 3 != 0").select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.lit("new").alias("checkpoint_value"), F.lit(5).alias("items_synced"), F.when(F.col("s_suppkey") % 3 == 2, "boom").alias("error_message"))
    return merge.merge_checkpoint(old, new)


@query("""
SELECT source_package, vuln_id, CASE WHEN vuln_id LIKE '%1' THEN 'under-review' ELSE status END AS status FROM advisories
""")
def apply_reviews(spark, sf_dir):
    a = Tables(spark, sf_dir).advisories.withColumn("reviewed_at", F.lit(None).cast("timestamp_ntz")).withColumn("reviewed_by", F.lit(None).cast("string"))
    decided = a.filter("vuln_id like '%1' or vuln_id like '%2'").select("source_package", "vuln_id", F.when(F.col("vuln_id").like("%1"), "under-review").otherwise("nonsense").alias("status"), F.col("updated_at").alias("reviewed_at"), F.lit("me").alias("reviewed_by"))
    return merge.apply_reviews(a, decided).select("source_package", "vuln_id", "status")


@query("""
SELECT rpm_name, vuln_name, coalesce(s_suppkey % 2 = 0, false) AS reviewed FROM (SELECT DISTINCT rpm_name, vuln_name FROM mappings) LEFT JOIN supplier ON rpm_name = 'none-' || CAST(s_suppkey AS STRING) AND s_suppkey % 3 = 1
""")
def review_mappings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = t.mappings.distinct().withColumn("reviewed", F.lit(False)).withColumn("updated_at", F.lit(None).cast("timestamp"))
    decided = t.supplier.filter("s_suppkey % 3 = 1").select(F.concat(F.lit("NONE-"), "s_suppkey").alias("rpm_name"), (F.col("s_suppkey") % 2 == 0).alias("reviewed"), F.current_timestamp().alias("updated_at"))
    return merge.review_mappings(m, decided).select("rpm_name", "vuln_name", "reviewed")


@query("""
SELECT source_package, vuln_id, CASE WHEN vuln_id LIKE '%3' THEN 'status and reviewer required' ELSE 'invalid status' END AS reason FROM advisories WHERE vuln_id LIKE '%2' OR vuln_id LIKE '%3'
""")
def invalid_reviews(spark, sf_dir):
    a = Tables(spark, sf_dir).advisories.filter("vuln_id like '%1' or vuln_id like '%2' or vuln_id like '%3'")
    decided = a.select("source_package", "vuln_id", F.when(F.col("vuln_id").like("%2"), "nonsense").otherwise("fixed").alias("status"), F.when(~F.col("vuln_id").like("%3"), "me").alias("reviewed_by"))
    return merge.invalid_reviews(decided).select("source_package", "vuln_id", "reason")


@query("""
SELECT rpm_name, vuln_name, coalesce((SELECT count(*) FROM sources WHERE source_package = rpm_name), 0) AS usage_count FROM (SELECT DISTINCT rpm_name, vuln_name FROM mappings)
""")
def mapping_usage(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = t.mappings.distinct().withColumn("usage_count", F.lit(0).cast("long"))
    return merge.count_usage(m, t.sources.withColumnRenamed("source_package", "rpm_name"))
