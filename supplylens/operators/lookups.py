"""Batch lookups, pages and searches.

Every lookup answers all its keys in one job. Orders always end in a unique key, so that pages are stable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplylens.functions import icontains, severity_rank


def page(df: DataFrame, order: Sequence[Column | str], limit: int | None = None, offset: int = 0, default: int = 100, cap: int = 1000) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in ``order``; a limit that is missing or not positive becomes ``default``, one above ``cap`` becomes ``cap``."""
    n = default if not limit or limit <= 0 else min(limit, cap)
    out = df.orderBy(*order)
    return (out.offset(offset) if offset > 0 else out).limit(n)


def page_after(df: DataFrame, order: Sequence[tuple[str, str]], after: tuple | None = None, limit: int = 100) -> DataFrame:
    """The next ``limit`` rows behind the position ``after`` (values of the ordered columns; none: the first page).

    ``order`` names columns with ``asc`` or ``desc``, nulls last, and ends in a unique column. A page is a filter and a bounded top-k, however far it lies
    behind the first, and pages taken to the end give every row once, ties included, whatever is added before the position meanwhile.
    """
    rows = df
    if after is not None:
        beyond, same = F.lit(False), F.lit(True)
        for (name, way), value in zip(order, after, strict=True):
            c = F.col(name)
            if value is not None:
                later = (c > F.lit(value)) if way == "asc" else (c < F.lit(value))
                beyond = beyond | (same & (c.isNull() | later))
            same = same & c.eqNullSafe(F.lit(value))
        rows = df.filter(F.coalesce(beyond, F.lit(False)))
    return rows.orderBy(*[F.asc_nulls_last(c) if way == "asc" else F.desc_nulls_last(c) for c, way in order]).limit(limit)


def position(row, order: Sequence[tuple[str, str]]) -> tuple:
    """Where a row of :func:`page_after` stands."""
    return tuple(row[c] for c, _ in order)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    return top_k_per_group(df, keys, order, 1)


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= k).drop("__rank")


def get_vulnerability(v: DataFrame, ids: DataFrame) -> DataFrame:
    """(asked, vulnerability columns) for each ``asked`` id; one that isn't there is resolved through aliases to the first related id."""
    own = ids.select("asked").distinct().join(v, F.col("asked") == v["id"]).withColumn("__rank", F.lit(0))
    related_ids = related(v).select(F.col("id").alias("asked"), F.col("related_id").alias("__rid"))
    through = ids.select("asked").distinct().join(related_ids, "asked").join(v, F.col("__rid") == v["id"]).drop("__rid").withColumn("__rank", F.lit(1))
    return dedupe_first(own.unionByName(through), ["asked"], ["__rank", "id"]).drop("__rank")


def related(v: DataFrame) -> DataFrame:
    """(id, related_id): vulnerabilities that share an alias edge in either direction, one hop, without itself.

    Aliases that name no vulnerability can be asked for as ``id`` too; ``related_id`` always exists.
    """
    edges = v.select("id", F.explode("aliases").alias("alias")).distinct()
    both = edges.select(F.col("alias").alias("id"), F.col("id").alias("related_id")).unionByName(edges.select("id", F.col("alias").alias("related_id")))
    both = both.filter("id != related_id").distinct()
    return both.join(v.select(F.col("id").alias("related_id")), "related_id", "left_semi").select("id", "related_id")


def batch_get(v: DataFrame, affected: DataFrame, ids: DataFrame, columns: Sequence[Column | str] = ("*",)) -> DataFrame:
    """Vulnerabilities with their nested affected rows, by ``pos`` of ``ids`` (pos, id); unknown ids drop out.

    ``columns`` (``pos`` among them) are taken before the rows are ordered, so that lists of which only a figure is wanted are not shuffled.
    """
    nested = affected.groupBy("vuln_id").agg(F.sort_array(F.collect_list(F.struct("package_name", "source", "ecosystem"))).alias("affected"))
    return ids.join(v, "id").join(nested, F.col("id") == F.col("vuln_id"), "left").drop("vuln_id").select(*columns).orderBy("pos")


def changelog(v: DataFrame, modified_since=None, updated_since=None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of vulnerabilities changed since then (inclusive), newest update first, unknown updates last, with the total."""
    rows = v
    if modified_since is not None:
        rows = rows.filter(F.col("modified") >= F.lit(modified_since))
    if updated_since is not None:
        rows = rows.filter(F.col("updated_at") >= F.lit(updated_since))
    total = rows.agg(F.count("*").alias("total"))
    return page(rows, [F.desc_nulls_last("updated_at"), "id"], limit, offset).crossJoin(F.broadcast(total))  # the total is one row


def affected_by_package(affected: DataFrame, names: DataFrame) -> DataFrame:
    """(package_name, ecosystem asked or null, vuln_id, total): distinct ids for each asked name, case-sensitive; a null ecosystem asks for all."""
    asked = names.select(F.col("package_name"), F.col("ecosystem").alias("asked_ecosystem")).distinct()
    hit = asked.join(affected.select("package_name", "ecosystem", "vuln_id"), "package_name")
    hit = hit.filter(F.col("asked_ecosystem").isNull() | (F.col("asked_ecosystem") == F.col("ecosystem"))).select("package_name", "asked_ecosystem", "vuln_id").distinct()
    return hit.withColumn("total", F.count("*").over(Window.partitionBy("package_name", "asked_ecosystem")))


def affected_by_purl(affected: DataFrame, purls: DataFrame) -> DataFrame:
    return affected.join(purls.select("purl").filter("purl != ''").distinct(), "purl").select("purl", "vuln_id").distinct()


def batch_query_affected(affected: DataFrame, queries: DataFrame, limit: int = 100) -> DataFrame:
    """(result_key, vuln_id): for each query the most specific criterion it has: purl, vendor and name, ecosystem and name, or name.

    ``queries``: purl, vendor, ecosystem, name (null or empty where absent). At most ``limit`` ids for each query, in order; queries
    without a hit or without criteria are absent.
    """
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    kind = F.when(has("purl"), "purl").when(has("vendor") & has("name"), "vendor").when(has("ecosystem") & has("name"), "ecosystem").when(has("name"), "name")
    key = (
        F.when(kind == "purl", F.col("purl"))
        .when(kind == "vendor", F.concat_ws("/", "vendor", "name"))
        .when(kind == "ecosystem", F.concat_ws(":", "ecosystem", "name"))
        .otherwise(F.col("name"))
    )
    asked = queries.select("purl", "vendor", "ecosystem", "name", kind.alias("kind"), key.alias("result_key")).filter("kind is not null").distinct()
    rows = affected.select(F.col("purl").alias("a_purl"), F.col("vendor").alias("a_vendor"), F.col("ecosystem").alias("a_ecosystem"), F.col("package_name").alias("a_name"), "vuln_id")
    on = {
        "purl": [F.col("purl") == F.col("a_purl")],
        "vendor": [F.col("vendor") == F.col("a_vendor"), F.col("name") == F.col("a_name")],
        "ecosystem": [F.col("ecosystem") == F.col("a_ecosystem"), F.col("name") == F.col("a_name")],
        "name": [F.col("name") == F.col("a_name")],
    }
    hits = None
    for k, condition in on.items():
        part = asked.filter(F.col("kind") == k).join(rows, condition).select("result_key", "vuln_id")
        hits = part if hits is None else hits.unionByName(part)
    return top_k_per_group(hits.distinct(), ["result_key"], ["vuln_id"], limit)


def image_document(images: DataFrame, platforms: DataFrame, tags: DataFrame) -> DataFrame:
    """Images with nested platforms and current tags, both sorted; images without any have empty lists."""
    pl = platforms.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("platform_id", "os", "architecture"))).alias("platforms"))
    tg = tags.filter("current").groupBy("image_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    out = images.join(pl, "image_id", "left").join(tg, "image_id", "left")
    return out.withColumn("platforms", F.coalesce("platforms", F.array().cast(pl.schema["platforms"].dataType))).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def image_packages(platforms: DataFrame, platform_packages: DataFrame, packages: DataFrame, arch: str | None = None) -> DataFrame:
    """Packages of every platform of every image, ordered by type, name and version within it."""
    rows = platforms.filter(F.col("architecture") == arch) if arch else platforms
    rows = rows.select("image_id", "platform_id").join(platform_packages, "platform_id").join(packages, "package_id")
    return rows.orderBy("image_id", "platform_id", "type", "name", "version", "package_id")


def search_packages(packages: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Packages whose name contains the text, in any case."""
    return page(packages.filter(icontains("name", name)), ["name", "version", "package_id"], limit)


def pick_sbom(platforms: DataFrame, sboms: DataFrame, arch: str = "amd64", source: str = "syft") -> DataFrame:
    """The SBOM of each image's platform of that architecture and source; of several the first platform's."""
    rows = platforms.filter(F.col("architecture") == arch).join(sboms.filter(F.col("source") == source), "platform_id")
    return dedupe_first(rows, ["image_id"], ["platform_id"])


def has_sbom(platforms: DataFrame, sboms: DataFrame) -> DataFrame:
    return platforms.join(sboms.select("platform_id").distinct(), "platform_id", "left_semi")


def source_status(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.orderBy("source")


def list_advisories(adv: DataFrame, package: str | None = None, status: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of advisories, newest first, with the total of the filter."""
    rows = adv if package is None else adv.filter(F.col("source_package") == package)
    rows = rows if status is None else rows.filter(F.col("status") == status)
    total = rows.agg(F.count("*").alias("total"))
    return page(rows, [F.desc("updated_at"), "source_package", "vuln_id"], limit, offset, cap=10_000).crossJoin(F.broadcast(total))


def prior_decisions(adv: DataFrame, n: int = 10) -> DataFrame:
    """The newest decided advisories (any status but ``detected``) of every package."""
    return top_k_per_group(adv.filter("status != 'detected'"), ["source_package"], [F.desc("updated_at"), "vuln_id"], n)


def scans_by_image(scans: DataFrame, digests: DataFrame) -> DataFrame:
    """Scans whose platform key belongs to one of the image digests."""
    return scans.withColumn("digest", F.split_part("platform_id", F.lit("|"), F.lit(1))).filter(F.contains("platform_id", F.lit("|"))).join(digests.select("digest").distinct(), "digest", "left_semi")


def list_findings(findings: DataFrame, severity: str | None = None) -> DataFrame:
    """Findings by scan, severity as text, vulnerability and package; the severity filter ignores case."""
    rows = findings if severity is None else findings.filter(F.lower("severity") == severity.lower())
    return rows.orderBy("scan_id", "severity", "vuln_id", "package_name")


def list_items(items: DataFrame, status: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    rows = items if status is None else items.filter(F.col("status") == status)
    return page(rows, [F.desc("priority"), "created_at", "queue", "key"], limit, offset)


def item_history(items: DataFrame, history: DataFrame, n: int = 100) -> DataFrame:
    """Items with their latest ``n`` transitions, newest first."""
    last = top_k_per_group(history, ["queue", "key"], [F.desc("created_at"), F.desc("id")], n)
    nested = last.groupBy("queue", "key").agg(F.sort_array(F.collect_list(F.struct("created_at", "id", "to_status")), asc=False).alias("history"))
    return items.join(nested, ["queue", "key"], "left")


def vuln_name_index(affected: DataFrame) -> DataFrame:
    return affected.select(F.lower("package_name").alias("name")).filter("name != ''").distinct()


def newest_images(images: DataFrame, k: int = 10) -> DataFrame:
    return page(images, [F.desc("created_at"), "image_id"], k)


def list_images(images: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One page of images, newest first, each row with ``total`` and ``has_more``: whether images follow the page."""
    n = 100 if not limit or limit <= 0 else min(limit, 1000)
    rows = page(images, [F.desc("created_at"), "image_id"], n, offset).crossJoin(F.broadcast(images.agg(F.count("*").alias("total"))))  # one row
    return rows.withColumn("has_more", F.col("total") > offset + n)


def sort_advisories(adv: DataFrame) -> DataFrame:
    """Open ones first, then by severity, then by id."""
    return adv.orderBy(F.when(F.col("status") == "detected", 0).otherwise(1), severity_rank("severity"), "vuln_id", "source_package")


def review_queue(adv: DataFrame, n: int) -> DataFrame:
    """The first ``n`` open advisories of each package by CVSS, then EPSS; missing scores count as 0."""
    rows = adv.filter("status = 'detected'")
    return top_k_per_group(rows, ["source_package"], [F.desc(F.coalesce("cvss", F.lit(0.0))), F.desc(F.coalesce("epss", F.lit(0.0))), "vuln_id"], n)


def set_compare(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of both sides with ``side``: both, left or right."""
    x = a.select(*keys).distinct().withColumn("__a", F.lit(True))
    y = b.select(*keys).distinct().withColumn("__b", F.lit(True))
    side = F.when(F.col("__a").isNull(), "right").when(F.col("__b").isNull(), "left").otherwise("both")
    return x.join(y, list(keys), "full_outer").select(*keys, side.alias("side"))


def feed_input(adv: DataFrame) -> DataFrame:
    """Affected and fixed advisories, one for each package and vulnerability, affected first."""
    rows = adv.filter("status = 'affected'").withColumn("__at", F.lit(0)).unionByName(adv.filter("status = 'fixed'").withColumn("__at", F.lit(1)))
    return dedupe_first(rows, ["source_package", "vuln_id"], ["__at"]).drop("__at")
