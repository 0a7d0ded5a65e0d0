"""Joins of the catalogue, scan and work tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplylens.functions import cve_for_enrichment, icontains
from supplylens.operators.lookups import newest_images, page


def enrich(v: DataFrame, kev: DataFrame, epss: DataFrame, notes: DataFrame) -> DataFrame:
    """Vulnerabilities with their KEV row (``in_kev``, ``date_added``), EPSS ``score`` and number and vendors of notes, by CVE.

    The three sides have a row for each CVE at most (notes are grouped first), so no row multiplies.
    """
    by_cve = v.withColumn("cve_id", cve_for_enrichment("id", "aliases"))
    grouped = notes.groupBy("cve_id").agg(F.count("*").alias("n_notes"), F.array_join(F.sort_array(F.collect_set("vendor")), ",").alias("note_vendors"))
    out = by_cve.join(kev.select("cve_id", "date_added"), "cve_id", "left").join(epss.select("cve_id", "score"), "cve_id", "left").join(grouped, "cve_id", "left")
    return out.withColumn("in_kev", F.col("date_added").isNotNull()).withColumn("n_notes", F.coalesce("n_notes", F.lit(0).cast("long")))


def _image_hits(images: DataFrame, platforms: DataFrame, platform_packages: DataFrame, packages: DataFrame) -> DataFrame:
    hit = packages.select("package_id").distinct()
    rows = platform_packages.join(hit, "package_id", "left_semi").select("platform_id").distinct()
    rows = platforms.join(rows, "platform_id", "left_semi").select("image_id").distinct()
    return images.join(rows, "image_id", "left_semi").orderBy("image_id")


def images_by_purl(images: DataFrame, platforms: DataFrame, platform_packages: DataFrame, packages: DataFrame, purl: str) -> DataFrame:
    """Images that contain the package, each once."""
    return _image_hits(images, platforms, platform_packages, packages.filter(F.col("purl") == purl))


def images_by_package(images: DataFrame, platforms: DataFrame, platform_packages: DataFrame, packages: DataFrame, name: str, version: str | None = None, limit: int | None = None) -> DataFrame:
    """Images with a package whose name (and version) contains the text, in any case."""
    rows = packages.filter(icontains("name", name))
    rows = rows if version is None else rows.filter(icontains("version", version))
    return page(_image_hits(images, platforms, platform_packages, rows), ["image_id"], limit)


def diff_packages_pairs(platform_packages: DataFrame, pairs: DataFrame) -> DataFrame:
    """(from_id, to_id, package_id, change): packages added and removed between the platforms of each pair.

    Both sides are tagged with the pair and counted together, which is one shuffle on (pair, package).
    """
    pp = platform_packages.select("platform_id", "package_id").distinct()
    old = pairs.join(pp.withColumnRenamed("platform_id", "from_id"), "from_id").select("from_id", "to_id", "package_id", F.lit(1).alias("side"))
    new = pairs.join(pp.withColumnRenamed("platform_id", "to_id"), "to_id").select("from_id", "to_id", "package_id", F.lit(2).alias("side"))
    sides = old.unionByName(new).groupBy("from_id", "to_id", "package_id").agg(F.sum("side").alias("sides"))
    return sides.filter("sides < 3").select("from_id", "to_id", "package_id", F.when(F.col("sides") == 1, "removed").otherwise("added").alias("change"))


def diff_packages(platform_packages: DataFrame, from_id, to_id) -> DataFrame:
    """(package_id, change) between two platforms."""
    of = lambda i: platform_packages.filter(F.col("platform_id") == F.lit(i)).select("package_id").distinct()
    removed = of(from_id).join(of(to_id), "package_id", "left_anti").withColumn("change", F.lit("removed"))
    return removed.unionByName(of(to_id).join(of(from_id), "package_id", "left_anti").withColumn("change", F.lit("added")))


def latest_findings(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of the latest scan of each platform and scanner; scans that tie all count."""
    w = Window.partitionBy("platform_id", "scanner").orderBy(F.desc("completed_at"))
    last = scans.filter(F.col("completed_at").isNotNull()).withColumn("__rank", F.rank().over(w)).filter("__rank = 1").drop("__rank")
    return last.select("scan_id", "platform_id", "scanner").join(findings, "scan_id")


def latest_scan(scans: DataFrame) -> DataFrame:
    """One scan for each platform and scanner, the latest; ties go to the smaller id."""
    w = Window.partitionBy("platform_id", "scanner").orderBy(F.desc_nulls_last("completed_at"), "scan_id")
    return scans.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def platforms_needing_scan(images: DataFrame, tags: DataFrame, platforms: DataFrame, sboms: DataFrame, scans: DataFrame, scanner: str, db_version: str, now, days: int = 30, newest: int = 10) -> DataFrame:
    """Platforms with an SBOM, of images tagged within ``days`` or among the newest, not yet scanned with this database."""
    recent = tags.filter(F.col("current") & (F.col("tagged_at") > F.lit(now) - F.make_dt_interval(F.lit(days)))).select("image_id")
    wanted = recent.union(newest_images(images, newest).select("image_id")).distinct()
    rows = platforms.join(wanted, "image_id", "left_semi").join(sboms.select("platform_id").distinct(), "platform_id", "left_semi")
    done = latest_scan(scans.filter(F.col("scanner") == scanner)).filter((F.col("status") == "completed") & (F.col("db_version") == db_version))
    return rows.join(done.select("platform_id"), "platform_id", "left_anti").select("platform_id", "image_id")


def rescan_worklist(tags: DataFrame, platforms: DataFrame, now, scanner: str = "grype", days: int = 30, limit: int = 1000) -> DataFrame:
    """Keys ``scanner|platform`` to scan again after a database update; the limit is the size of the work list."""
    recent = tags.filter(F.col("current") & (F.col("tagged_at") > F.lit(now) - F.make_dt_interval(F.lit(days)))).select("image_id").distinct()
    rows = platforms.join(recent, "image_id", "left_semi").select(F.concat_ws("|", F.lit(scanner), F.col("platform_id").cast("string")).alias("key"))
    return rows.distinct().orderBy("key").limit(limit)


def platforms_missing_sbom(platforms: DataFrame, sboms: DataFrame) -> DataFrame:
    return platforms.join(sboms.select("platform_id").distinct(), "platform_id", "left_anti")


def unmatched_packages(sources: DataFrame, match_state: DataFrame) -> DataFrame:
    return sources.join(match_state.select("source_package").distinct(), "source_package", "left_anti")


def expired_leases(items: DataFrame, leases: DataFrame, now) -> DataFrame:
    """Items whose lease ran out before ``now``, oldest lease first."""
    rows = leases.filter(F.col("lease_expires") < F.lit(now)).join(items, ["queue", "key"])
    return rows.orderBy("lease_expires", "queue", "key")


def review_evidence(adv: DataFrame, v: DataFrame, affected: DataFrame) -> DataFrame:
    """One row per advisory with summary, details, first severity and all affected entries of the vulnerability in order of source."""
    entries = affected.groupBy("vuln_id").agg(F.sort_array(F.collect_list(F.struct("source", "package_name", "vendor"))).alias("entries"))
    told = v.select(F.col("id").alias("vuln_id"), "summary", "details", F.get("severity", F.lit(0)).alias("first_severity"))
    return adv.select("source_package", "vuln_id").join(told, "vuln_id", "left").join(entries, "vuln_id", "left")
