"""One alert per rule until somebody resolves it: a stateful stream of metric points and resolve events.

Both kinds of event are keyed by rule and may arrive out of order. They wait in the state of their rule until the watermark has
passed them (an event-time timer wakes the rule up) and are then taken in order of (timestamp, event_id), so the
result depends on neither batches nor restarts. The state of a rule is one flag and the events of the last ``delay``; it lives in
the RocksDB state store and its snapshots in the checkpoint folder. Points that break no rule never reach the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tapeloom.operators.metrics import breached

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
POINT, RESOLVE, TICK = "point", "resolve", "tick"
CONTROL_SCHEMA = "rule string, timestamp timestamp_ntz, event_id bigint, kind string"
_EVENT = "micros bigint, event_id bigint, value double, kind string, level string"
_COLUMNS = ["micros", "event_id", "value", "kind", "level"]
_OUT = "rule string, micros bigint, event_id bigint, value double, change string, level string"


class _Lifecycle(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "active boolean, level string")
        self.waiting = handle.getListState("waiting", _EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 - Spark's name
        found = pd.concat(list(rows))[_COLUMNS]
        # Ticks only move the watermark.
        events = [
            (int(m), int(e), None if pd.isna(v) else float(v), k, None if pd.isna(lv) else lv)
            for m, e, v, k, lv in found[found["kind"] != TICK].itertuples(index=False, name=None)]
        if events:
            self.waiting.appendList(events)
            self.handle.registerTimer(-(-min(e[0] for e in events) // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted((tuple(e) for e in self.waiting.get()), key=lambda e: e[:2])
        due = [e for e in events if e[0] <= passed]
        if not due:
            return
        later = events[len(due):]
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(-(-later[0][0] // 1000))
        active, held = self.active.get() if self.active.exists() else (False, None)
        out = []
        for micros, event_id, value, kind, level in due:
            if kind == POINT and not active:
                active, held = True, level
                out.append((key[0], micros, event_id, value, "fired", level))
            elif kind == RESOLVE and active:
                active = False
                out.append((key[0], micros, event_id, None, "resolved", held))
        self.active.update((active, held))
        if out:
            yield pd.DataFrame(out, columns=["rule", "micros", "event_id", "value", "change", "level"]).astype({"value": "float64"})

    def close(self) -> None:
        pass


def lifecycle(points: DataFrame, controls: DataFrame, rules: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(rule, timestamp, event_id, value, change, level): an alert fires once and stays until it is resolved.

    points (name, value, timestamp, event_id) and controls (CONTROL_SCHEMA: resolve events, and ticks that move time on when a stream
    ends) are streams. Events later than ``delay`` are dropped by the watermark. Run it with ``with_rocksdb``.
    """
    broken = points.join(rules, "name").filter(breached())
    events = broken.select("rule", "timestamp", "event_id", "value", F.lit(POINT).alias("kind"), "level").unionByName(
        controls.select("rule", "timestamp", "event_id", F.lit(None).cast("double").alias("value"), "kind", F.lit(None).cast("string").alias("level")))
    timed = events.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("micros", F.unix_micros("timestamp"))
    changes = timed.withWatermark("timestamp", delay).groupBy("rule").transformWithStateInPandas(_Lifecycle(), _OUT, "append", "EventTime")
    return changes.select("rule", F.timestamp_micros("micros").cast("timestamp_ntz").alias("timestamp"), "event_id", "value", "change", "level")


class with_rocksdb:  # noqa: N801 - used as a context manager only
    """Stateful streams started inside keep their state in RocksDB."""

    def __init__(self, spark: SparkSession):
        self.spark, self.before = spark, spark.conf.get(STORE, None)

    def __enter__(self) -> None:
        self.spark.conf.set(STORE, ROCKSDB)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(STORE)
        else:
            self.spark.conf.set(STORE, self.before)
