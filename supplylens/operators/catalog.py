"""The catalogue as one job, and pluggable scanners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplylens.functions.ordering import order_key, order_of
from supplylens.operators.cdc import tag_references
from supplylens.operators.matching import scan_platforms
from supplylens.operators.merge import insert_ignore
from supplylens.operators.normalize import platforms_from_manifest, sbom_packages
from supplylens.operators.windows import tag_history

Scanner = Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame]
SCANNERS: dict[str, Scanner] = {"ranges": scan_platforms}

def register_scanner(name: str, fn: Scanner) -> None:
    """Make a scanner known: (platform_packages, packages, affected, vulnerabilities) -> findings."""
    SCANNERS[name] = fn


def range_key(bound: Column, range_type: Column, ecosystem: Column | None = None) -> Column:
    """Sort key of a bound by its range's type; null where the type has no order."""
    return order_key(bound, order_of(range_type, ecosystem))


def drop_unordered_ranges(affected: DataFrame) -> DataFrame:
    """Affected rows without the ranges whose type has no order (commits)."""
    return affected.withColumn("ranges", F.filter("ranges", lambda r: order_of(r["range_type"]).isNotNull()))


def build_catalog(manifests: DataFrame, tags: DataFrame, sboms: DataFrame) -> dict[str, DataFrame]:
    """All catalogue tables from manifests (image_id, content), tag events (event_id, repository, tag, image_id, ts) and SBOMs (platform_id, content).

    ``platforms``; ``tags``: validity of each tag that names an image; ``references``: what to look at again; ``packages``: each purl once;
    ``platform_packages``: associations, of platforms that are there.
    """
    platforms = platforms_from_manifest(manifests).dropDuplicates(["platform_id"])
    named = tags.join(tag_references(tags).select("reference").distinct(), F.concat_ws(":", "repository", "tag") == F.col("reference"), "left_semi")
    found = sbom_packages(sboms).join(platforms.select("platform_id"), "platform_id", "left_semi")
    packages = found.groupBy("purl").agg(F.min(F.struct("name", "version", "type")).alias("p")).select("purl", "p.*")
    links = found.select("platform_id", "purl").distinct()
    return {
        "platforms": platforms,
        "tags": tag_history(named, ["repository", "tag"]),
        "references": tag_references(tags).distinct(),
        "packages": packages,
        "platform_packages": links,
    }


def add_associations(known: DataFrame, new: DataFrame) -> DataFrame:
    """Associations only ever grow: packages that a newer SBOM drops stay linked."""
    return insert_ignore(known, new, ["platform_id", "purl"])
