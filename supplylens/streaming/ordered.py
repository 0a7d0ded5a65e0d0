"""Work-log folds as streams that put late events in their place, keep timers and let finished items go.

:class:`OrderedFold` holds each key's events back until the watermark has passed them, folds them in order of (ts, event_id) and returns the state they
lead to. So the stream gives what the batch fold gives, whatever the order in which events come, as long as none is later than the watermark allows.
State leaves by timers in event time: an item that is finished when its retention has passed, any other, where that is asked for, when nothing
has happened to it for ``idle``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from supplylens.streaming import worklog

#: Column types of the buffered events and of the folded states, in the order of the fold's arguments.
FOLDS: dict[str, tuple[str, str, Callable]] = {
    "requests": ("kind string, priority int, not_before timestamp", worklog.REQUEST_STATE, worklog.request_step),
    "lifecycle": ("to_status string", worklog.LIFECYCLE_STATE, worklog.lifecycle_step),
}
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class OrderedFold(StatefulProcessor):
    """One fold of :data:`FOLDS` over each key's events, in order up to the watermark."""

    def __init__(self, fold: str, retention_s: int, idle_s: int | None):
        self.retention, self.idle = retention_s * 1000, None if idle_s is None else idle_s * 1000
        event, state, self.step = FOLDS[fold]
        self.columns, self.out = _names(event), _names(state)
        # Parsed where there is a session; workers have none.
        self.waiting_type, self.held_type = StructType.fromDDL("ts timestamp, event_id long, " + event), StructType.fromDDL(state + ", last_ms long")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_type)
        self.held = handle.getValueState("held", self.held_type)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            new = [tuple(worklog._none(x) for x in r) for r in frame[["ts", "event_id", *self.columns]].itertuples(index=False)]
            if new:
                self.waiting.appendList([(r[0].to_pydatetime() if hasattr(r[0], "to_pydatetime") else r[0], *(int(x) if hasattr(x, "item") else x for x in r[1:])) for r in new])
                self.handle.registerTimer(int(min(pd.Timestamp(r[0]).timestamp() for r in new) * 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        events = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        ms = lambda r: int(pd.Timestamp(r[0]).timestamp() * 1000)
        due, later = [r for r in events if ms(r) < mark], [r for r in events if ms(r) >= mark]
        old = tuple(self.held.get()) if self.held.exists() else None
        if due:
            state, last = (None, 0) if old is None else (old[:-1], old[-1])
            for r in due:
                # What has left by its own time counts as gone, whenever its timer fires.
                gone = state is not None and self._lasts(state[0]) is not None and last + self._lasts(state[0]) <= ms(r)
                state, last = self.step(None if gone else state, *r[2:]), ms(r)
            self.held.update((*state, last))
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(ms(later[0]) + 1)
            else:
                self.waiting.clear()
            if self._lasts(state[0]) is not None:
                self.handle.registerTimer(last + self._lasts(state[0]))
            yield pd.DataFrame([(*key, *state)], columns=["queue", "key", *self.out])
        elif old is not None and not later and self._lasts(old[0]) is not None and old[-1] + self._lasts(old[0]) <= mark:
            self.held.clear()

    def _lasts(self, status: str | None) -> int | None:
        """For how long an item with this status is held after its last event."""
        return self.retention if status in worklog.TERMINAL else self.idle

    def close(self) -> None:
        pass


def ordered_fold_stream(events: DataFrame, fold: str, watermark: str = "10 minutes", retention_s: int = 7 * 86_400, idle_s: int | None = None) -> DataFrame:
    """Streaming form of :func:`worklog.fold_requests` (``fold="requests"``) or :func:`worklog.replay_lifecycle` (``"lifecycle"``), equal to the batch for events no later than ``watermark``.

    Each trigger yields the new states of the keys whose events the watermark has passed. A finished item that is asked for again after ``retention_s``
    begins anew, with its counts at 0; so does any that was idle for ``idle_s``, where that is given. Events with a null ``ts``, queue or key are left out. Needs the RocksDB state store, which is set here.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    event, state, _ = FOLDS[fold]
    rows = events.filter("ts is not null and queue is not null and key is not null").select("queue", "key", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), *_names(event))
    out = f"queue string, key string, {state}"
    return rows.withWatermark("ts", watermark).groupBy("queue", "key").transformWithStateInPandas(OrderedFold(fold, retention_s, idle_s), out, "Update", "EventTime")
