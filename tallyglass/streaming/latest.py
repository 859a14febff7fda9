"""Latest capture of each item on a stream (G5, W5): keyed value state with an event-time timer.

An item's state is the newest capture so far. A newer one replaces it and goes on; an item whose newest
capture lies further behind the watermark than ``keep`` is forgotten, so state does not grow for ever.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTING = "spark.sql.streaming.stateStore.providerClass"


def session_for_state(spark: SparkSession) -> SparkSession:
    """A session of the same application whose state is kept in RocksDB, as keyed value state needs; the given one stays as it is."""
    own = spark.newSession()
    own.conf.set(SETTING, PROVIDER)
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    return own


class _Latest(StatefulProcessor):
    """``latest_at_us`` is a row's time in microseconds, ``tie`` the column that settles equal times."""

    def __init__(self, tie: str, keep: int) -> None:
        self.tie, self.keep = tie, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", T.StructType([T.StructField(c, T.LongType()) for c in ("at", "tie", "due")]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, due, new = None, None, None
        if self.newest.exists():
            at, tie, due = self.newest.get()
            best = (at, tie)
        for frame in rows:
            top = frame.sort_values(["latest_at_us", self.tie]).iloc[[-1]]
            found = (int(top["latest_at_us"].iloc[0]), int(top[self.tie].iloc[0]))
            if best is None or found > best:
                best, new = found, top
        if new is not None:
            if due is not None:
                self.handle.deleteTimer(due)
            due = best[0] // 1000 + 1000 * self.keep
            self.handle.registerTimer(due)
            self.newest.update((*best, due))
            yield new.drop(columns="latest_at_us")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        yield from ()

    def close(self) -> None:
        pass


def latest_stream(items: DataFrame, id: str, ts: str = "ts", tie: str = "event_id", late: str = "10 minutes", keep: int = 24 * 3600) -> DataFrame:
    """The change log of newest captures: a row each time an item's newest capture (by ``ts``, ``tie``) changes.

    The last row of an item is what ``merge.latest_items`` gives over all captures that were not later than
    ``late``. ``ts`` is a timestamp, ``tie`` a whole number. An item is forgotten ``keep`` seconds after its newest
    capture; what comes for it later still lies above the watermark and so is newer than what was
    forgotten. Rows without an id, or without a time, are no captures and are left out. The session must
    keep its state in RocksDB (``session_for_state``); the output mode is update.
    """
    marked = items.where(F.col(id).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late).withColumn("latest_at_us", F.unix_micros(ts))
    return marked.groupBy(id).transformWithStateInPandas(_Latest(tie, keep), items.schema, "update", "eventTime")
