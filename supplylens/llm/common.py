"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it, as a Java character class.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a local folder will do as long as all tasks run in this process; on a cluster it must be named.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-supplylens-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, rows: int | None = None, per_part: int = 100_000) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that lost executors cost no recomputation.

    Where a bound on its ``rows`` is known, there are as many partitions as they fill, and not one for each shuffle
    partition: iterations over small tables then neither write nor schedule thousands of empty files.
    """
    shared_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(rows // per_part + 1)).checkpoint(eager=True)


def shared_table(df: DataFrame, name: str, *partition_by: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/supplylens-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_keys(groups: DataFrame, size_col: str, total: int, share: int = 1000) -> DataFrame:
    """The groups that hold at least ``total / share`` rows: never more than ``share`` of them.

    The bound makes them safe to broadcast whatever the size of the data.
    """
    return groups.filter(F.col(size_col) * share >= F.lit(total))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with one row per group, robust against hot groups.

    Groups that hold at least ``total / share`` of the rows (so at most ``share``
    groups) are broadcast; the others are joined through a shuffle in which no key
    has more than that part of the rows. ``size_col`` of ``groups`` is the
    number of ``rows`` in the group.
    """
    hot = hot_keys(groups, size_col, total, share)
    cold = groups.filter(F.col(size_col) * share < F.lit(total))
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return near.unionByName(far)


def is_training(doc_id: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves a remainder other than 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(True))
