"""Ingest runs as a stream of status changes: which ones got stuck."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from graphlens.operators.runs import QUEUED_AGE, RUNNING_AGE

OUT = "run_id bigint, action string, since timestamp"
STATE = "seq bigint, status string, since bigint"
AGE = {"queued": QUEUED_AGE, "running": RUNNING_AGE}
ACTION = {"queued": "requeue", "running": "fail"}


class Watch(StatefulProcessor):
    """Remembers the last change of a run by sequence; a timer in event time reports it when it has stood too long.

    A run has one value and one timer. A finished run is remembered until the
    watermark has passed its end, as an older change may still arrive until then;
    then its state is cleared, so that only runs that are open are kept.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else None
        for pdf in rows:
            row = pdf.loc[pdf["seq"].idxmax()]
            if last is None or row.seq > last[0]:
                last = (int(row.seq), row.status, int(row.ts.timestamp() * 1000))
        self.last.update(last)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # never before the watermark, which a timer must lie beyond
        self.handle.registerTimer(max(last[2] + AGE.get(last[1], 0) * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, status, since = self.last.get()
        self.last.clear()
        if status in AGE:
            yield pd.DataFrame({"run_id": [key[0]], "action": [ACTION[status]], "since": [pd.Timestamp(since, unit="ms")]})

    def close(self) -> None:
        pass


def stuck_runs(changes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Runs whose last change (run_id, seq, status, ts) is too old by event time.

    The stream has to be started with the RocksDB state store (`run.drain(..., state_store=ROCKSDB)`).
    """
    return changes.withWatermark("ts", delay).groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=Watch(), outputStructType=OUT, outputMode="append", timeMode="eventTime"
    )
