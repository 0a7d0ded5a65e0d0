"""Incremental ingest of landed records, with progress that survives restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from supplylens.operators.normalize import NORMALIZERS, rejects

RECORDS = "source STRING, key STRING, content STRING, raw_hash STRING"
PROGRESS = "source STRING, records LONG, rejected LONG, error STRING"


def ingest_stream(spark: SparkSession, path: str, out: str, checkpoint: str, source: str, available_now: bool = True) -> StreamingQuery:
    """Normalise new files below ``path`` (JSON lines of ``RECORDS``) and write the affected rows of each batch.

    A batch writes into a folder of its own number, so a batch that is replayed after a failure replaces what it wrote. Readers take
    the last batch of each (vulnerability, source). Records that can't be read whole go to ``rejects`` with a reason, and ``progress`` says of each batch
    how many rows it read and rejected, or the text of the error that stopped it, which is raised again.
    """

    def write(batch: DataFrame, number: int) -> None:
        def progress(read: int | None, rejected: int | None, error: str | None) -> None:
            row = spark.createDataFrame([(source, read, rejected, error)], PROGRESS)
            row.write.mode("overwrite").json(f"{out}/progress/batch={number}")

        batch = batch.persist()
        try:
            bad = rejects(batch, [source]).persist()
            v, affected = NORMALIZERS[source](batch.filter(batch["source"] == source))
            v.write.mode("overwrite").parquet(f"{out}/vulnerabilities/batch={number}")
            affected.write.mode("overwrite").parquet(f"{out}/affected/batch={number}")
            bad.write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")
            progress(batch.count(), bad.count(), None)
            bad.unpersist()
        except Exception as e:
            progress(None, None, str(e))
            raise
        finally:
            batch.unpersist()

    writer = spark.readStream.schema(RECORDS).json(path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def current_affected(spark: SparkSession, out: str) -> DataFrame:
    """Affected rows after all batches: of each (vulnerability, source) those of the last batch that has it."""
    rows = spark.read.option("basePath", f"{out}/affected").parquet(f"{out}/affected")
    last = rows.groupBy("vuln_id", "source").agg({"batch": "max"}).withColumnRenamed("max(batch)", "batch")
    return rows.join(last, ["vuln_id", "source", "batch"], "left_semi")
