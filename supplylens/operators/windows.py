"""Ordered histories: tag validity, time in state, current state and planned picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tag_history(events: DataFrame, keys: list[str], value: str = "image_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Validity intervals (keys, value, valid_from, valid_to, current): a change of value ends the one before; repeated values extend it."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    changed = events.withColumn("__new", ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).filter("__new")
    out = changed.select(*keys, value, F.col(ts).alias("valid_from"), F.lead(ts).over(w).alias("valid_to"))
    return out.withColumn("current", F.col("valid_to").isNull())


def time_in_state(history: DataFrame) -> DataFrame:
    """Each transition with the seconds until the next one of its item; the last one's are null."""
    w = Window.partitionBy("queue", "key").orderBy("created_at", "id")
    nxt = F.lead("created_at").over(w)
    return history.select("queue", "key", "id", F.col("to_status").alias("status"), (nxt.cast("double") - F.col("created_at").cast("double")).alias("seconds"))


def current_state(history: DataFrame) -> DataFrame:
    """The last transition of every item."""
    w = Window.partitionBy("queue", "key").orderBy(F.desc("created_at"), F.desc("id"))
    return history.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def budgeted_top_k(items: DataFrame, in_progress: DataFrame, capacity: int, now, batch: int) -> DataFrame:
    """Items each queue could start now: eligible ones in order, as many as ``batch`` and the capacity that work in progress leaves.

    ``in_progress``: queue, n. A report; nothing is claimed.
    """
    w = Window.partitionBy("queue").orderBy(F.asc_nulls_first("not_before"), F.desc("priority"), "created_at", "key")
    ready = items.filter((F.col("status") == "pending") & (F.col("not_before").isNull() | (F.col("not_before") <= F.lit(now))))
    ranked = ready.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= batch)  # a limit for each queue, kept map-side
    ranked = ranked.join(in_progress.select("queue", F.col("n").alias("__busy")), "queue", "left")
    room = F.greatest(F.lit(0), F.least(F.lit(batch), F.lit(capacity) - F.coalesce("__busy", F.lit(0))))
    return ranked.filter(F.col("rank") <= room).drop("__busy")


def carry_header(lines: DataFrame, pattern: str, by: str, pos: str = "pos", line: str = "line") -> DataFrame:
    """Add ``header``: the last line at or above that matches the pattern, within each ``by``."""
    w = Window.partitionBy(by).orderBy(pos)
    return lines.withColumn("header", F.last(F.when(F.col(line).rlike(pattern), F.col(line)), ignorenulls=True).over(w))


def cap_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")
