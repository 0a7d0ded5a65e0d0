"""Registered queries over files: each writes the driver's tables in a landed format below the shared folder and reads them back with the library's reader."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplylens.plans.catalogue import Tables
from supplylens.plans.standins import expand
from supplylens.sources import readers, sinks
from supplylens.sources.documents import read_documents, write_documents
from supplylens.sources.shared import shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Rows that go into one file of a feed or archive.
IN_A_FILE = 500


def query(oracle: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = expand(oracle)
        return fn

    return add


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/supplylens-{name}-{uuid.uuid4().hex}"


def _file_number(key: str):
    return F.floor(F.col(key) / IN_A_FILE).cast("string")


@query("""
SELECT 'own/adv/' || CAST(s_suppkey AS STRING) || '.json' AS key, '{"id":' || CAST(s_suppkey AS STRING) || ',"name":"' || s_name || '"}' AS content,
  sha256('{"id":' || CAST(s_suppkey AS STRING) || ',"name":"' || s_name || '"}') AS raw_hash FROM supplier
""")
def read_advisory_tree(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier
    root = folder(spark, "tree")
    content = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    write_documents(s.select(F.col("s_suppkey").cast("string").alias("k"), content.alias("d")), f"{root}/adv", "k", "d")
    # A file of another kind, which the pattern leaves out.
    write_documents(s.select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_comment" if "s_comment" in s.columns else "s_name").alias("d")), f"{root}/adv", "k", "d", suffix=".md", mode="append")
    return readers.read_advisory_tree(spark, root, "own", "adv", "*.json").select("key", "content", "raw_hash")


@query("""
SELECT 'CVE-' || CAST(p_partkey AS STRING) AS vuln_id, p_name AS description, CASE WHEN p_partkey % 3 = 0 THEN 'Rejected' ELSE 'Analyzed' END AS status FROM part WHERE p_partkey % 7 <> 0
""")
def read_nvd_feed(spark, sf_dir):
    """Feed files of 500 entries, of which those without an id are skipped."""
    p = Tables(spark, sf_dir).part
    entry = F.struct(
        F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string"))).alias("id"),
        F.when(F.col("p_partkey") % 3 == 0, "Rejected").otherwise("Analyzed").alias("vulnStatus"),
        F.array(F.struct(F.lit("en").alias("lang"), F.col("p_name").alias("value"))).alias("descriptions"),
    )
    feed = p.groupBy(_file_number("p_partkey").alias("k")).agg(F.to_json(F.struct(F.collect_list(F.struct(entry.alias("cve"))).alias("vulnerabilities"))).alias("d"))
    path = folder(spark, "nvd")
    write_documents(feed, path, "k", "d")
    get = lambda at: F.get_json_object("content", at)
    return readers.read_nvd_feed(spark, path).select("vuln_id", get("$.descriptions[0].value").alias("description"), get("$.vulnStatus").alias("status"))


def _zipped(pdf: pd.DataFrame) -> pd.DataFrame:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in zip(pdf["member"], pdf["content"]):
            z.writestr(name, content)
    return pd.DataFrame({"k": pdf["k"].iloc[:1], "d": [out.getvalue()]})


@query("""
WITH m AS (SELECT 'osv/eco' || CAST(floor(p_partkey / 500) AS BIGINT) || '/P-' || CAST(p_partkey AS STRING) || '.json' AS key, '{"id":"P-' || CAST(p_partkey AS STRING) || '","summary":"' || p_name || '"}' AS content FROM part)
SELECT key, content, sha256(content) AS raw_hash FROM m
""")
def read_osv_zip(spark, sf_dir):
    """Archives of 500 records and a file of another kind each, read in stretches of 4 KB."""
    p = Tables(spark, sf_dir).part
    name = F.concat(F.lit("P-"), F.col("p_partkey").cast("string"))
    record = F.to_json(F.struct(name.alias("id"), F.col("p_name").alias("summary")))
    k = F.concat(F.lit("eco"), _file_number("p_partkey")).alias("k")
    rows = p.select(k, F.explode(F.array(F.struct(F.concat(name, F.lit(".json")).alias("member"), record.alias("content")), F.struct(F.concat(name, F.lit(".txt")).alias("member"), F.col("p_name").alias("content")))).alias("m"))
    path = folder(spark, "osv")
    write_documents(rows.select("k", "m.*").groupBy("k").applyInPandas(_zipped, "k string, d binary"), path, "k", "d", suffix=".zip")
    return readers.read_osv_zip(spark, path, stretch_bytes=4096).select("key", "content", "raw_hash")


@query("SELECT 'CVE-' || CAST(p_partkey AS STRING) AS cve, p_brand AS vendor, CAST(DATE '2024-01-01' + CAST(p_size AS INTEGER) AS STRING) AS added FROM part")
def read_kev(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    entry = F.struct(
        F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string")).alias("cveID"), F.col("p_brand").alias("vendorProject"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")).cast("string").alias("dateAdded")
    )
    path = folder(spark, "kev")
    write_documents(p.groupBy(_file_number("p_partkey").alias("k")).agg(F.to_json(F.struct(F.collect_list(entry).alias("vulnerabilities"))).alias("d")), path, "k", "d")
    return readers.read_kev(spark, path).select(F.explode("vulnerabilities").alias("v")).select(F.col("v.cveID").alias("cve"), F.col("v.vendorProject").alias("vendor"), F.col("v.dateAdded").alias("added"))


@query("""
SELECT 'CVE-' || CAST(p_partkey AS STRING) AS cve_id, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size / 64.0 END AS score, CAST(p_size AS DOUBLE) / 128 AS percentile,
  'v' || CAST(floor(p_partkey / 500) AS BIGINT) AS model_version, '2024-02-03' AS score_date FROM part WHERE p_partkey % 13 <> 0
""")
def read_epss(spark, sf_dir):
    """Score files with their head lines; some lines are short, some scores can't be read."""
    p = Tables(spark, sf_dir).part
    cve = F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string"))
    score = F.when(F.col("p_partkey") % 11 == 0, "?").otherwise((F.col("p_size") / 64).cast("string"))
    line = F.when(F.col("p_partkey") % 13 == 0, F.concat_ws(",", cve, score)).otherwise(F.concat_ws(",", cve, score, (F.col("p_size") / 128).cast("string")))
    number = _file_number("p_partkey")
    head = F.concat(F.lit("#model_version:v"), F.col("k"), F.lit(",score_date:2024-02-03T00:00:00+0000\ncve,epss,percentile\n"))
    files = p.groupBy(number.alias("k")).agg(F.concat_ws("\n", F.collect_list(line)).alias("body")).select("k", F.concat(head, "body").alias("d"))
    path = folder(spark, "epss")
    write_documents(files, path, "k", "d", suffix=".csv")
    return readers.read_epss(spark, path).select("cve_id", F.col("score").cast("double").alias("score"), F.col("percentile").cast("double").alias("percentile"), "model_version", F.col("score_date").cast("string").alias("score_date"))


@query("""
WITH l AS (SELECT s_nationkey, s_suppkey, 2 * row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)
SELECT CAST(s_nationkey AS STRING) AS list, CAST(n - 2 AS INTEGER) AS pos, 'CVE-' || CAST(s_suppkey AS STRING) AS line FROM l
UNION ALL SELECT CAST(s_nationkey AS STRING), CAST(n - 1 AS INTEGER), chr(9) || '- p' || CAST(s_suppkey AS STRING) || ' <unfixed>' FROM l
""")
def read_debian_list(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier
    two = F.concat(F.lit("CVE-"), F.col("s_suppkey").cast("string"), F.lit("\n\t- p"), F.col("s_suppkey").cast("string"), F.lit(" <unfixed>"))
    files = s.groupBy(F.col("s_nationkey").cast("string").alias("k")).agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", two.alias("t")))), lambda x: x["t"])).alias("d"))
    path = folder(spark, "debian")
    write_documents(files, path, "k", "d", suffix=".list")
    return readers.read_debian_list(spark, path).select(F.regexp_extract("file", r"([^/]+)\.list$", 1).alias("list"), "pos", "line")


@query("""SELECT 'sha256:' || CAST(s_suppkey AS STRING) AS platform_id, '{"name":"' || s_name || '"}' AS content FROM supplier""")
def read_sboms(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier
    path = folder(spark, "sboms")
    write_documents(s.select(F.col("s_suppkey").cast("string").alias("k"), F.to_json(F.struct(F.col("s_name").alias("name"))).alias("d")), path, "k", "d", suffix=".spdx.json")
    return readers.read_sboms(spark, path)


@query("""SELECT 'sha256:' || CAST(s_suppkey AS STRING) AS image_id, '{"mediaType":"' || s_name || '"}' AS content FROM supplier""")
def read_manifests(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier
    path = folder(spark, "manifests")
    write_documents(s.select(F.col("s_suppkey").cast("string").alias("k"), F.to_json(F.struct(F.col("s_name").alias("mediaType"))).alias("d")), path, "k", "d")
    return readers.read_manifests(spark, path)


def _map_files(p: DataFrame, key, value, path: str) -> None:
    """JSON objects of 500 entries a file."""
    entries = F.map_from_entries(F.collect_list(F.struct(key, value)))
    write_documents(p.groupBy(_file_number("p_partkey").alias("k")).agg(F.to_json(entries).alias("d")), path, "k", "d")


@query("""SELECT 'pkg-' || CAST(p_partkey AS STRING) AS name, p_type AS vendor, lower(p_brand) AS product FROM part WHERE p_partkey % 5 <> 0""")
def read_cpe_index(spark, sf_dir):
    """Names are written in capitals; every fifth entry is too short."""
    p = Tables(spark, sf_dir).part
    path = folder(spark, "cpe")
    _map_files(p, F.concat(F.lit("PKG-"), F.col("p_partkey").cast("string")), F.when(F.col("p_partkey") % 5 == 0, F.array("p_type")).otherwise(F.array("p_type", "p_brand")), path)
    return readers.read_cpe_index(spark, path)


@query("""
WITH r AS (SELECT p_partkey, lower(p_brand) AS b, lower(p_type) AS m, p_partkey % 3 AS c FROM part)
SELECT DISTINCT 'rpm-' || CAST(p_partkey AS STRING) AS rpm_name, v AS vuln_name FROM (SELECT *, b AS v FROM r UNION ALL SELECT *, m FROM r) WHERE c <> 2
UNION SELECT 'plain-' || CAST(p_partkey AS STRING), b FROM r
""")
def read_name_mappings(spark, sf_dir):
    """Reviewed files, from which low confidence is left out, and plain ones, in one folder."""
    p = Tables(spark, sf_dir).part
    confidence = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("p_partkey") % 3 + 1).cast("int"))
    entry = F.struct(F.concat(F.lit("RPM-"), F.col("p_partkey").cast("string")).alias("rpm_name"), F.array("p_brand", "p_type").alias("proposed_names"), confidence.alias("confidence"))
    path = folder(spark, "mappings")
    _map_files(p, F.concat(F.lit("plain-"), F.col("p_partkey").cast("string")), F.array("p_brand"), path)
    reviewed = p.groupBy(F.concat(F.lit("reviewed-"), _file_number("p_partkey")).alias("k")).agg(F.to_json(F.struct(F.collect_list(entry).alias("mappings"))).alias("d"))
    write_documents(reviewed, path, "k", "d", mode="append")
    return readers.read_name_mappings(spark, path)


@query("SELECT 'Part ' || CAST(p_partkey AS STRING) AS name, p_name AS description FROM part")
def read_descriptions(spark, sf_dir):
    path = folder(spark, "descriptions")
    _map_files(Tables(spark, sf_dir).part, F.concat(F.lit("Part "), F.col("p_partkey").cast("string")), F.col("p_name"), path)
    return readers.read_descriptions(spark, path)


@query("SELECT o_orderkey AS id, o_orderpriority AS queue, o_orderstatus AS to_status, CAST(NULL AS STRING) AS worker_id FROM orders")
def read_queue_history(spark, sf_dir):
    """A log without some of the columns, which are null then."""
    path = folder(spark, "history")
    rows = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderpriority").alias("queue"), F.col("o_orderstatus").alias("to_status"))
    rows.write.parquet(path)
    return readers.read_queue_history(spark, path).select("id", "queue", "to_status", "worker_id")


@query("SELECT o_orderkey AS probe_id, 'i' || CAST(o_custkey AS STRING) AS image, o_orderstatus = 'F' AS success, CAST(o_custkey % 9 AS INTEGER) AS layers FROM orders")
def read_probe_log(spark, sf_dir):
    path = folder(spark, "probes")
    o = Tables(spark, sf_dir).orders
    rows = o.select(F.col("o_orderkey").alias("probe_id"), F.concat(F.lit("i"), F.col("o_custkey").cast("string")).alias("image"), (F.col("o_orderstatus") == "F").alias("success"), (F.col("o_custkey") % 9).cast("int").alias("layers"))
    rows.write.json(path)
    return readers.read_probe_log(spark, path, fmt="json").select("probe_id", "image", "success", "layers")


@query("SELECT s_suppkey, 'n1/' || s_name AS repository FROM supplier WHERE s_nationkey = 1")
def filter_namespace(spark, sf_dir):
    """``n1`` is an organisation, ``n10`` to ``n19`` are others."""
    s = Tables(spark, sf_dir).supplier
    repos = s.select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/"), "s_name").alias("repository"))
    return readers.filter_namespace(repos, "n1")


@query("SELECT 's' || CAST(s_nationkey AS STRING) AS source, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS ids FROM supplier GROUP BY s_nationkey")
def write_bronze(spark, sf_dir):
    """Records land by source in two appends of one half each."""
    s = Tables(spark, sf_dir).supplier.select(F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("source"), F.col("s_suppkey").cast("long").alias("id"))
    path = folder(spark, "bronze")
    for half in range(2):
        sinks.write_bronze(s.filter(F.col("id") % 2 == half), path)
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("SELECT source_package, count(*) AS n, string_agg(vuln_id || ':' || status, ',' ORDER BY vuln_id, status) AS listed FROM advisories GROUP BY source_package")
def write_package_advisories(spark, sf_dir):
    """One file for each package; what it holds is read back from the files."""
    path = folder(spark, "packages")
    sinks.write_package_advisories(Tables(spark, sf_dir).advisories.select("source_package", "vuln_id", "status"), path)
    docs = read_documents(spark, path).select(F.from_json("document", "package string, advisories array<struct<vuln_id: string, status: string>>").alias("d")).select("d.*")
    listed = F.array_join(F.transform("advisories", lambda a: F.concat_ws(":", a["vuln_id"], a["status"])), ",")
    return docs.select(F.col("package").alias("source_package"), F.size("advisories").cast("long").alias("n"), listed.alias("listed"))
