"""Change detection between runs. A run over unchanged input yields nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplylens.functions import is_skipped_tag
from supplylens.operators.lookups import page_after


def changed_records(new: DataFrame, known: DataFrame, keys: Sequence[str] = ("vuln_id", "source"), digest: str = "raw_hash") -> DataFrame:
    """Records whose hash isn't the one on file; before any parsing, so parsing costs only what changed."""
    return new.join(known.select(*keys, digest), [*keys, digest], "left_anti")


def epss_changes(new: DataFrame, old: DataFrame, eps: float = 0.01) -> DataFrame:
    """Scores of new CVEs and those that moved by more than ``eps`` in single precision."""
    before = old.select("cve_id", F.col("score").cast("float").alias("__old"))
    moved = F.abs(F.col("score").cast("float") - F.col("__old")) > F.lit(eps).cast("float")
    return new.join(before, "cve_id", "left").filter(F.col("__old").isNull() | moved).drop("__old")


def kev_changes(new: DataFrame, old: DataFrame, had_checkpoint: bool) -> DataFrame:
    """Entries whose id is new; where there are none but the catalogue changed since a checkpoint, all entries."""
    fresh = new.join(old.select("cve_id").distinct(), "cve_id", "left_anti")
    if had_checkpoint and fresh.isEmpty():
        return new
    return fresh


def note_changes(new: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed notes, the hash table that replaces ``hashes``) by (cve_id, vendor, hash of the content)."""
    hashed = new.withColumn("hash", F.sha2(F.to_json("content"), 256))
    return hashed.join(hashes, ["cve_id", "vendor", "hash"], "left_anti"), hashed.select("cve_id", "vendor", "hash")


def changed_parts(listing: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Parts of a feed whose etag or version isn't the one on file; a part without an etag always counts as changed."""
    known = checkpoints.select("source", "part", F.col("etag").alias("__etag"))
    same = (F.col("etag") != "") & F.col("etag").eqNullSafe(F.col("__etag"))
    return listing.join(known, ["source", "part"], "left").filter(~F.coalesce(same, F.lit(False))).drop("__etag")


def tree_changes(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """(path, hash, change) of the paths that are new or differ since the old listing (path, hash); all paths, as added, where there is no base.

    ``modified``: the path was there with another hash. ``renamed``: its content stood at a path that is gone; ``copied``: at one that is still there
    as it was; ``added``: nowhere.
    """
    if old is None:
        return new.withColumn("change", F.lit("added"))
    before = old.select("path", F.col("hash").alias("__old"))
    now = new.select(F.col("path"), F.col("hash").alias("__now"))
    # Of each old content, whether a path that held it still does.
    stands = before.join(now, "path", "left").groupBy(F.col("__old").alias("hash")).agg(F.bool_or(F.col("__old").eqNullSafe(F.col("__now"))).alias("__stands"))
    out = new.join(before, "path", "left").filter(F.col("__old").isNull() | (F.col("__old") != F.col("hash"))).join(stands, "hash", "left")
    change = F.when(F.col("__old").isNotNull(), "modified").when(F.col("__stands"), "copied").when(F.col("__stands").isNotNull(), "renamed").otherwise("added")
    return out.select(*new.columns, change.alias("change"))


def changed_vulns(v: DataFrame, affected: DataFrame, since=None, cap: int | None = None, after: tuple | None = None) -> DataFrame:
    """(id, updated_at) of what was updated after ``since``, oldest first; on the first run all ids with a named package, by id, without a time.

    ``cap`` is the work list's size; 0 lifts it. A run that was capped resumes behind its last row: ``after`` is that row's (updated_at, id), so ids that share
    its time are not lost.
    """
    if since is None:
        ids = affected.filter("package_name != ''").select(F.col("vuln_id").alias("id")).distinct()
        rows, order, most = ids.withColumn("updated_at", F.lit(None).cast(v.schema["updated_at"].dataType)), [("id", "asc")], 10_000 if cap is None else cap
        after = after and after[1:]
    else:
        rows, order, most = v.filter(F.col("updated_at") > F.lit(since)).select("id", "updated_at"), [("updated_at", "asc"), ("id", "asc")], 5_000 if cap is None else cap
    return page_after(rows, order, after, most or 2**31 - 1)


def tag_references(tags: DataFrame) -> DataFrame:
    """References ``repository:tag`` of the tags that name images."""
    return tags.filter(~is_skipped_tag("tag")).select(F.concat_ws(":", "repository", "tag").alias("reference"))
