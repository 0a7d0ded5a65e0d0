"""Readers of landed feeds and logs. Spark's own readers list and split their files, but for archives, which :mod:`supplylens.sources.archives` cuts up."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplylens.sources import schemas as S
from supplylens.sources.archives import ArchiveSource

READERS: dict[str, Callable[..., DataFrame]] = {}


def register_source(name: str, fn: Callable[..., DataFrame]) -> None:
    """Make a reader known under a name."""
    READERS[name] = fn


def read_source(spark: SparkSession, name: str, *args, **kwargs) -> DataFrame:
    return READERS[name](spark, *args, **kwargs)


def read_advisory_tree(spark: SparkSession, root: str, source: str, subdir: str = "", glob: str = "*.json") -> DataFrame:
    """(source, key, content, raw_hash) of every file below ``root/subdir`` whose base name fits; the key is ``source/path below root``."""
    base = f"{root.rstrip('/')}/{subdir}".rstrip("/")
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(base)
    rel = F.regexp_replace("path", F.lit("^.*?" + _quote(root.rstrip("/").split(":", 1)[-1].rstrip("/")) + "/"), F.lit(""))
    return rows.select(F.lit(source).alias("source"), F.concat(F.lit(source + "/"), rel).alias("key"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("raw_hash"))


def _quote(s: str) -> str:
    return r"\Q" + s.replace(r"\E", r"\E\\E\Q") + r"\E"


def read_nvd_feed(spark: SparkSession, paths) -> DataFrame:
    """(source, vuln_id, content): one row for each CVE of NVD 2.0 feed files, plain or gzipped; entries without an id are skipped."""
    feed = spark.read.schema(S.NVD_FEED).option("multiLine", True).json(paths)
    rows = feed.select(F.explode("vulnerabilities.cve").alias("cve")).filter("coalesce(cve.id, '') != ''")
    return rows.select(F.lit("nvd").alias("source"), F.col("cve.id").alias("vuln_id"), F.to_json("cve").alias("content"))


def read_osv_zip(spark: SparkSession, paths, stretch_bytes: int = 32 << 20, streaming: bool = False) -> DataFrame:
    """(source, key, content, raw_hash): the JSON members of ecosystem archives, or of those right below a folder; members over 16 MiB have null as content.

    Stretches of an archive's directory are tasks of their own. As a stream, only archives that are new or have changed are read.
    """
    spark.dataSource.register(ArchiveSource)
    named = json.dumps([paths] if isinstance(paths, str) else list(paths))
    members = (spark.readStream if streaming else spark.read).format("zip_members").option("paths", named).option("stretch_bytes", str(stretch_bytes)).load()
    ecosystem = F.regexp_extract("archive", r"([^/]+?)(\.zip)?$", 1)
    key = F.concat_ws("/", F.lit("osv"), ecosystem, "member")
    return members.select(F.lit("osv").alias("source"), key.alias("key"), "content", F.sha2("content", 256).alias("raw_hash"))


def read_kev(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(S.KEV).option("multiLine", True).json(path)


def read_epss(spark: SparkSession, path) -> DataFrame:
    """(cve_id, score, percentile, model_version, score_date) from EPSS CSV files, gzipped or not.

    The comment line names model and date of its file; the header line and short lines are skipped; numbers that can't be read count as 0.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    head = lines.filter(F.col("line").startswith("#")).select(
        "file", F.regexp_extract("line", r"model_version:([^,]+)", 1).alias("model_version"), F.to_date(F.regexp_extract("line", r"score_date:(\d{4}-\d{2}-\d{2})", 1)).alias("score_date")
    )
    parts = F.split("line", ",")
    body = lines.filter(~F.col("line").startswith("#") & ~F.col("line").startswith("cve,") & (F.size(parts) >= 3))
    number = lambda i: F.coalesce(F.expr(f"try_cast(split(line, ',')[{i}] as float)"), F.lit(0.0).cast("float"))
    rows = body.select("file", F.get(parts, F.lit(0)).alias("cve_id"), number(1).alias("score"), number(2).alias("percentile"))
    # One head line for each file: a table of the number of files.
    return rows.join(head, "file", "left").drop("file")


def read_debian_list(spark: SparkSession, path) -> DataFrame:
    """(file, pos, line) in file order."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return text.select("file", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))


def read_sboms(spark: SparkSession, root: str) -> DataFrame:
    """(platform_id, content) of ``<digest without its prefix>.spdx.json`` files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.spdx.json").option("recursiveFileLookup", True).load(root)
    digest = F.regexp_extract("path", r"([^/]+)\.spdx\.json$", 1)
    return files.select(F.concat(F.lit("sha256:"), digest).alias("platform_id"), F.decode("content", "UTF-8").alias("content"))


def read_manifests(spark: SparkSession, path) -> DataFrame:
    """(image_id, content) of manifest files named by digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.concat(F.lit("sha256:"), F.regexp_extract("path", r"([^/]+?)(\.json)?$", 1)).alias("image_id"), F.decode("content", "UTF-8").alias("content"))


def _map_file(spark: SparkSession, path, kind: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", kind)).alias("k", "v"))


def read_cpe_index(spark: SparkSession, path) -> DataFrame:
    """(name, vendor, product) from ``{name: [vendor, product, version?]}``; names in lower case, short entries dropped, of a name the first by vendor and product."""
    rows = _map_file(spark, path, "map<string,array<string>>").filter("size(v) >= 2").select(F.lower("k").alias("name"), F.get("v", F.lit(0)).alias("vendor"), F.lower(F.get("v", F.lit(1))).alias("product"))
    w = Window.partitionBy("name").orderBy("vendor", "product")
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def read_name_mappings(spark: SparkSession, path) -> DataFrame:
    """(rpm_name, vuln_name) in lower case, from reviewed mappings of at least medium confidence or from a plain map of name lists."""
    text = spark.read.text(path, wholetext=True)
    reviewed = text.select(F.explode(F.from_json("value", "struct<mappings: array<struct<rpm_name: string, proposed_names: array<string>, confidence: string>>>")["mappings"]).alias("m"))
    reviewed = reviewed.filter("m.confidence in ('high', 'medium')").select(F.col("m.rpm_name").alias("rpm_name"), F.explode("m.proposed_names").alias("vuln_name"))
    plain = text.filter(F.get_json_object("value", "$.mappings").isNull()).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("rpm_name", "names"))
    plain = plain.select("rpm_name", F.explode("names").alias("vuln_name"))
    return reviewed.unionByName(plain).select(F.lower("rpm_name").alias("rpm_name"), F.lower("vuln_name").alias("vuln_name")).distinct()


def read_descriptions(spark: SparkSession, path) -> DataFrame:
    """(name, description) from ``{name: text}``; names as they are written."""
    return _map_file(spark, path, "map<string,string>").select(F.col("k").alias("name"), F.col("v").alias("description"))


QUEUE_HISTORY = "id LONG, queue STRING, key STRING, from_status STRING, to_status STRING, worker_id STRING, error_message STRING, priority INT, not_before TIMESTAMP, created_at TIMESTAMP"
PROBE_LOG = "probe_id LONG, image STRING, ts TIMESTAMP, success BOOLEAN, duration DOUBLE, size LONG, layers INT, error STRING"


def _log(spark: SparkSession, path, schema: str, streaming: bool, fmt: str) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).format(fmt).load(path)


def read_queue_history(spark: SparkSession, path, streaming: bool = False, fmt: str = "parquet") -> DataFrame:
    return _log(spark, path, QUEUE_HISTORY, streaming, fmt)


def read_probe_log(spark: SparkSession, path, streaming: bool = False, fmt: str = "parquet") -> DataFrame:
    return _log(spark, path, PROBE_LOG, streaming, fmt)


def filter_namespace(repos: DataFrame, org: str) -> DataFrame:
    """Repositories of one organisation."""
    return repos.filter(F.col("repository").startswith(f"{org}/"))


def decode_json_or_yaml(df: DataFrame) -> DataFrame:
    """Make ``content`` JSON: rows that start with a brace or bracket stay in the JVM, the others are read as YAML where a reader is installed.

    Without one they keep their text, and the parser rejects them as malformed.
    """
    json_like = F.ltrim("content").rlike(r"^\s*[\[{]")
    try:
        import yaml
    except ImportError:
        return df

    @F.pandas_udf("string")
    def to_json(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return json.dumps(yaml.safe_load(t), default=str)
            except yaml.YAMLError:
                return t

        return texts.map(one)

    return df.filter(json_like).unionByName(df.filter(~json_like).withColumn("content", to_json("content")))


for _name, _fn in {
    "tree": read_advisory_tree, "nvd_feed": read_nvd_feed, "osv_zip": read_osv_zip, "kev": read_kev, "epss": read_epss, "debian": read_debian_list, "sboms": read_sboms,
    "manifests": read_manifests, "cpe": read_cpe_index, "mappings": read_name_mappings, "descriptions": read_descriptions, "queue_history": read_queue_history, "probe_log": read_probe_log,
}.items():
    register_source(_name, _fn)
