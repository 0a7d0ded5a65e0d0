"""Validity intervals on file that take late, repeated and retracted events in any order and batching.

Beside the intervals all events are kept, since a late event can part an interval that looked whole. Both tables are bucketed by the same keys: a batch of events
is merged into the buckets of its keys, and the intervals of these alone are worked out again. Whatever the order and the batches, the
rows are those of :func:`supplylens.operators.windows.tag_history` over all events that aren't retracted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.operators import bucketed
from supplylens.operators.windows import tag_history


@dataclass
class History:
    """Where the tables are, the keys whose history it is, and the columns of an event."""

    path: str
    keys: tuple[str, ...]
    value: str = "image_id"
    ts: str = "ts"
    event_id: str = "event_id"

    def _columns(self) -> list[str]:
        return [*self.keys, self.event_id, self.ts, self.value]


def create_history(history: History, events: DataFrame, buckets: int = 64) -> None:
    """Begin a history with some events (keys, event_id, ts, value), perhaps none."""
    rows = _once(history, events.select(*history._columns(), F.lit(False).alias("retracted")))
    bucketed.create_table(rows, f"{history.path}/events", history.keys, buckets)
    bucketed.create_table(_intervals(history, rows), f"{history.path}/intervals", history.keys, buckets)


def _once(history: History, rows: DataFrame) -> DataFrame:
    """One row for each event id of a key: repeats count once, and a retraction holds even where it comes before its event."""
    rest = [history.ts, history.value]
    whole = F.when(F.col(history.ts).isNotNull(), F.struct(*rest))
    return rows.groupBy(*history.keys, history.event_id).agg(F.min(whole).alias("__e"), F.max("retracted").alias("retracted")).select(*history.keys, history.event_id, "__e.*", "retracted")


def _intervals(history: History, events: DataFrame) -> DataFrame:
    valid = events.filter(~F.col("retracted") & F.col(history.ts).isNotNull())
    return tag_history(valid, list(history.keys), history.value, history.ts, history.event_id)


def apply_events(spark: SparkSession, history: History, events: DataFrame) -> list[int]:
    """Take up a batch of events; with a column ``retracted`` those marked so are taken back (their ts and value may be null). Returns the buckets that were read and rewritten.

    A batch that comes again changes nothing. Of events that share an id but not their values the smallest values count. Events without a time are kept, but open no interval.
    """
    marked = F.coalesce("retracted", F.lit(False)) if "retracted" in events.columns else F.lit(False)
    new = events.select(*history._columns(), marked.alias("retracted"))
    touched = bucketed.apply_merge(spark, f"{history.path}/events", new, lambda t, s: _once(history, t.unionByName(s)))
    if touched:
        known = bucketed.read_table(spark, f"{history.path}/events", touched)
        bucketed.replace_buckets(spark, f"{history.path}/intervals", _intervals(history, known), touched)
    return touched


def read_history(spark: SparkSession, history: History) -> DataFrame:
    """(keys, value, valid_from, valid_to, current)."""
    return bucketed.read_table(spark, f"{history.path}/intervals")
