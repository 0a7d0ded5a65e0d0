"""Domain tables as the driver's star schema stands in for them.

Each is one SELECT that Spark and DuckDB read alike, so a query and its oracle start from the same rows: orders stand for platforms, customers for
images, parts for packages, line items for packages of platforms and for affected entries, events for scans, probes and the work log.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "labels")

STANDINS = {
    "packages": """
        SELECT p_partkey AS package_id, p_name || ' ' || CAST(p_partkey AS STRING) AS name, p_type AS type, lower(p_brand) AS vendor,
          CAST(p_size AS STRING) || '.' || CAST(p_partkey % 20 AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) AS version,
          p_size * 10000 + (p_partkey % 20) * 100 + p_partkey % 7 AS code,
          'pkg:rpm/' || lower(p_brand) || '/' || CAST(p_partkey AS STRING) AS purl
        FROM part""",
    "platform_packages": "SELECT DISTINCT l_orderkey AS platform_id, l_partkey AS package_id FROM lineitem",
    "platforms": """
        SELECT o_orderkey AS platform_id, o_custkey AS image_id, 'linux' AS os,
          CASE WHEN o_orderkey % 3 = 0 THEN 'arm64' ELSE 'amd64' END AS architecture FROM orders""",
    "images": "SELECT c_custkey AS image_id, c_name AS name, c_acctbal AS created_at FROM customer",
    "sboms": "SELECT o_orderkey AS platform_id, CASE WHEN o_orderkey % 5 = 0 THEN 'native' ELSE 'syft' END AS source FROM orders WHERE o_orderkey % 4 <> 0",
    # Ranges of a package, in order of seq: bounded, through a last version, all versions, open, by hash, without introduction.
    "ranges": """
        SELECT package_id, seq,
          CASE WHEN seq % 6 IN (0, 4) THEN '0' WHEN seq % 6 = 1 THEN CAST(seq % 30 AS STRING) || '.0' WHEN seq % 6 = 3 THEN CAST(seq % 45 AS STRING) || '.2.0' ELSE '' END AS introduced,
          CASE WHEN seq % 6 = 0 THEN CAST(seq % 50 + 1 AS STRING) || '.3.1' WHEN seq % 6 = 2 THEN '*' WHEN seq % 6 = 4 THEN 'deadbeef01' WHEN seq % 6 = 5 THEN CAST(seq % 40 AS STRING) || '.10' ELSE '' END AS fixed,
          CASE WHEN seq % 6 = 1 THEN CAST(seq % 30 + 10 AS STRING) || '.5.1' ELSE '' END AS last_affected,
          CASE WHEN seq % 6 = 1 THEN (seq % 30) * 10000 WHEN seq % 6 = 3 THEN (seq % 45) * 10000 + 200 ELSE 0 END AS intro_code,
          CASE WHEN seq % 6 = 0 THEN (seq % 50 + 1) * 10000 + 301 WHEN seq % 6 = 5 THEN (seq % 40) * 10000 + 1000 ELSE 0 END AS fixed_code,
          CASE WHEN seq % 6 = 1 THEN (seq % 30 + 10) * 10000 + 501 ELSE 0 END AS last_code
        FROM (SELECT DISTINCT l_partkey AS package_id, l_suppkey AS seq FROM lineitem WHERE l_partkey % 11 <> 0 AND l_suppkey % 3 = l_partkey % 3)""",
    "affected": """
        SELECT 'CVE-2024-' || CAST(l_orderkey AS STRING) AS vuln_id, CASE WHEN l_linenumber % 3 = 0 THEN 'nvd' WHEN l_linenumber % 3 = 1 THEN 'osv' ELSE 'ghsa' END AS source,
          CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 'vendor' || CAST(l_suppkey % 5 AS STRING) END AS vendor, CASE WHEN l_suppkey % 3 = 0 THEN 'npm' WHEN l_suppkey % 3 = 1 THEN 'PyPI' ELSE '' END AS ecosystem,
          CASE WHEN l_partkey % 37 = 0 THEN '' ELSE 'pkg' || CAST(l_partkey AS STRING) END AS package_name,
          CASE WHEN l_partkey % 2 = 0 THEN 'pkg:rpm/p' || CAST(l_partkey AS STRING) ELSE '' END AS purl
        FROM lineitem""",
    # A vulnerability for each order; every third has the id of another scheme and the CVE as an alias; some aliases name other rows.
    "vulnerabilities": """
        SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'GHSA-' || CAST(o_orderkey AS STRING) ELSE 'CVE-2024-' || CAST(o_orderkey AS STRING) END AS id,
          CASE WHEN o_orderkey % 3 = 0 THEN 'CVE-2024-' || CAST(o_orderkey + 1 AS STRING) ELSE 'X-' || CAST(o_orderkey AS STRING) END AS alias,
          o_orderdate AS modified, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate END AS updated_at, o_orderpriority AS summary
        FROM orders""",
    "kev": "SELECT 'CVE-2024-' || CAST(c_custkey * 7 AS STRING) AS cve_id, c_mktsegment AS date_added FROM customer",
    "epss": "SELECT 'CVE-2024-' || CAST(p_partkey * 2 AS STRING) AS cve_id, p_retailprice AS score FROM part",
    "notes": "SELECT 'CVE-2024-' || CAST(s_suppkey * 3 % 90 AS STRING) AS cve_id, 'vendor' || CAST(s_nationkey % 4 AS STRING) AS vendor FROM supplier",
    "scans": """
        SELECT event_id AS scan_id, user_id AS platform_id, event_type AS scanner, ts AS completed_at,
          CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN event_id % 3 = 0 THEN 'v2' ELSE 'v1' END AS db_version FROM events""",
    "findings": """
        SELECT event_id AS scan_id, 'CVE-' || CAST(event_id % 97 AS STRING) AS vuln_id, 'pkg' || CAST(event_id % 13 AS STRING) AS package_name,
          CASE WHEN value < 20 THEN 'Critical' WHEN value < 40 THEN 'HIGH' WHEN value < 60 THEN 'medium' WHEN value < 80 THEN 'Low' ELSE 'negligible' END AS severity FROM events""",
    "history": """
        SELECT event_id AS id, 'q' || CAST(user_id % 3 AS STRING) AS queue, 'k' || CAST(user_id AS STRING) AS key, ts AS created_at, ts, value AS duration, user_id % 6 AS attempts,
          CASE WHEN event_type = 'view' THEN 'pending' WHEN event_type = 'click' THEN 'claimed' WHEN event_type = 'purchase' THEN 'succeeded' WHEN event_type = 'signup' THEN 'running' ELSE 'failed' END AS to_status
        FROM events""",
    "items": """
        SELECT 'q' || CAST(o_custkey % 5 AS STRING) AS queue, 'k' || CAST(o_orderkey AS STRING) AS key, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate AS created_at, o_orderdate AS updated_at,
          CASE WHEN o_orderkey % 7 = 0 THEN 'claimed' WHEN o_orderkey % 7 = 1 THEN 'running' WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderkey % 2 = 0 THEN 'succeeded' ELSE 'dead_letter' END AS status
        FROM orders""",
    "probes": "SELECT event_id AS probe_id, 'image' || CAST(user_id % 20 AS STRING) AS image, ts, event_type <> 'error' AS success, value AS duration, event_id * 3 % 1000 AS size, event_id % 12 AS layers FROM events",
    # Advisories: a package (part) and vulnerability (supplier) with a decision.
    "advisories": """
        SELECT 'src' || CAST(l_partkey AS STRING) AS source_package, 'CVE-2024-' || CAST(l_suppkey AS STRING) AS vuln_id, min(l_shipdate) AS updated_at,
          CASE WHEN sum(l_linenumber) % 4 = 0 THEN 'affected' WHEN sum(l_linenumber) % 4 = 1 THEN 'detected' WHEN sum(l_linenumber) % 4 = 2 THEN 'not-affected' ELSE 'fixed' END AS status,
          CASE WHEN sum(l_linenumber) % 3 = 0 THEN 'high' WHEN sum(l_linenumber) % 3 = 1 THEN 'medium' ELSE 'low' END AS confidence,
          max(l_quantity) AS cvss, CASE WHEN sum(l_linenumber) % 5 = 0 THEN NULL ELSE min(l_tax) END AS epss, 'note ' || CAST(count(*) AS STRING) AS notes,
          CASE WHEN count(*) % 2 = 0 THEN '' ELSE CAST(count(*) AS STRING) || '.0' END AS upstream_fixed_version
        FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "sources": """
        SELECT CASE WHEN p_partkey % 4 = 0 THEN 'pkg' || CAST(p_partkey AS STRING) WHEN p_partkey % 4 = 1 THEN 'libpkg' || CAST(p_partkey AS STRING) WHEN p_partkey % 4 = 2 THEN 'tool' || CAST(p_partkey AS STRING) ELSE 'none-' || CAST(p_partkey AS STRING) END AS source_package,
          min(CAST(p_size AS STRING) || '.1') AS upstream_version, min(CAST(p_size AS STRING) || '.1-1.el9') AS rpm_version
        FROM part GROUP BY 1""",
    "mappings": "SELECT 'none-' || CAST(s_suppkey * 4 + 3 AS STRING) AS rpm_name, 'pkg' || CAST(s_suppkey * 3 AS STRING) AS vuln_name FROM supplier",
    "cpe": "SELECT DISTINCT 'tool' || CAST(s_suppkey * 4 + 2 AS STRING) AS name, 'pkg' || CAST(s_suppkey * 11 AS STRING) AS product FROM supplier",
}


def expand(sql: str, mark: bool = False) -> str:
    """Put the stand-ins' SELECTs in front of a query that names them, as common table expressions; DuckDB and Spark both take the result."""
    used = [n for n in STANDINS if re.search(rf"\b{n}\b", sql)]
    ctes = ", ".join(f"{n} AS ({STANDINS[n]})" for n in used)
    if not ctes:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in as a DataFrame over the given folder's tables."""
    sql = STANDINS[name]
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b{t}\b", f"{{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
