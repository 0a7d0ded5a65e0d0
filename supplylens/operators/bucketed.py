"""Merges into a table on file that rewrite only the buckets they touch.

A table is a folder of Parquet, partitioned by a hash of its keys into a fixed number of buckets. ``apply_merge`` finds the buckets that the source's keys
fall into, reads these alone (partition pruning), applies one of the rules of :mod:`supplylens.operators.merge` to them and replaces them by dynamic
partition overwrite. All rows that a rule may change must share the source's keys, or the columns of them that are hashed.

A batch that is replayed does no harm: the rules are idempotent, and a run that ends while buckets are being replaced leaves some
buckets with the merged rows and others as they were, so the next run with the same source completes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.sources.shared import materialize, shared_dir

BUCKET, LIVE = "__bucket", "__live"
Rule = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class Bucketed:
    """Where a table is, the columns whose hash chooses the bucket, and the number of buckets."""

    path: str
    keys: tuple[str, ...]
    buckets: int

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")


def _write(table: Bucketed, rows: DataFrame, touched: DataFrame, mode: str) -> None:
    """Replace the buckets of ``touched``. Each gets a row that isn't live, so that a bucket that has lost its last row is replaced too.

    The rebalance splits large buckets into several files and joins nothing across buckets.
    """
    marks = touched.select(BUCKET, F.lit(False).alias(LIVE))
    out = rows.withColumns({BUCKET: table._bucket(), LIVE: F.lit(True)}).unionByName(marks, allowMissingColumns=True)
    out.hint("rebalance", BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{table.path}/data")


def create_table(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> Bucketed:
    """Write ``rows`` as a new table. More buckets mean smaller rewrites; with files of 128 MB as an aim, take the table's size over that.

    Null keys have a bucket like others. Column names must not begin with two underscores.
    """
    spark = rows.sparkSession
    table = Bucketed(path, tuple(keys), buckets)
    _write(table, rows, spark.range(buckets).select(F.col("id").cast("int").alias(BUCKET)), "errorifexists")
    spark.createDataFrame([(json.dumps({"keys": list(keys), "buckets": buckets, "schema": rows.schema.json()}),)], "value string").coalesce(1).write.text(f"{path}/meta")
    return table


def open_table(spark: SparkSession, path: str) -> Bucketed:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return Bucketed(path, tuple(meta["keys"]), meta["buckets"])


def read_table(spark: SparkSession, path: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """The table's rows, or those of some buckets."""
    rows = spark.read.parquet(f"{path}/data").filter(F.col(LIVE))
    if buckets is not None:
        rows = rows.filter(F.col(BUCKET).isin(*buckets))
    return rows.drop(BUCKET, LIVE)


def apply_merge(spark: SparkSession, path: str, source: DataFrame, rule: Rule) -> list[int]:
    """Merge ``source`` into the table by ``rule(target, source) -> new target`` and return the buckets that were read and rewritten.

    An empty source touches nothing. What the rule adds must fall into the buckets of the source's keys.
    """
    table = open_table(spark, path)
    # The source may be slow or read the table itself, so it is worked out once, before anything is replaced.
    fresh = materialize(source)
    touched = fresh.select(table._bucket().alias(BUCKET)).distinct()
    # Never more than there are buckets.
    found = sorted(r[0] for r in touched.collect())
    if not found:
        return []
    target = read_table(spark, path, found)
    _write(table, rule(target, fresh), spark.createDataFrame([(b,) for b in found], f"{BUCKET} int"), "overwrite")
    spark.catalog.refreshByPath(f"{path}/data")
    return found


def replace_buckets(spark: SparkSession, path: str, rows: DataFrame, buckets: Sequence[int]) -> None:
    """Put ``rows``, which must fall into these buckets, in place of what they hold."""
    if buckets:
        _write(open_table(spark, path), rows, spark.createDataFrame([(b,) for b in buckets], f"{BUCKET} int"), "overwrite")
        spark.catalog.refreshByPath(f"{path}/data")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/supplylens-{name}-{uuid.uuid4().hex}"
