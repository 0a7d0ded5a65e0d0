"""Writers of the landing zone and of published documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplylens.operators.aggregates import advisory_summary
from supplylens.operators.lookups import feed_input
from supplylens.operators.matching import to_osv
from supplylens.sources.documents import write_documents


def write_bronze(df: DataFrame, path: str, mode: str = "append") -> None:
    """Raw records by source."""
    df.write.mode(mode).partitionBy("source").parquet(path)


def write_osv_feed(advisories: DataFrame, path: str, prefix: str, ecosystem: str, purl: str, mode: str = "overwrite") -> None:
    """One JSON document a line: affected and fixed advisories, each package and vulnerability once."""
    to_osv(feed_input(advisories), prefix, ecosystem, purl).select("doc").write.mode(mode).text(path)


def package_documents(adv: DataFrame) -> DataFrame:
    """(package, document, n): each source package's advisories as one JSON document, in order of vulnerability."""
    cols = [c for c in adv.columns if c != "source_package"]
    one = F.struct("vuln_id", *[c for c in cols if c != "vuln_id"])
    grouped = adv.groupBy(F.col("source_package").alias("package")).agg(F.sort_array(F.collect_list(one)).alias("advisories"), F.count("*").alias("n"))
    return grouped.select("package", F.to_json(F.struct("package", "advisories")).alias("document"), "n")


def write_package_advisories(adv: DataFrame, path: str, mode: str = "overwrite", summary: str | None = None) -> None:
    """One file for each package, all in one folder, and in the folder ``summary`` a line of counts for each package."""
    if summary:
        advisory_summary(adv).write.mode(mode).json(summary)
    write_documents(package_documents(adv), path, "package", "document", mode=mode)
