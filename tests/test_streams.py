"""Stateful streams: alerts held until they are resolved, minute tables behind a cursor."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tapeloom.operators import metrics
from tapeloom.sinks import tables as sinks
from tapeloom.streaming import alerts, jobs

RULES = [("low", "quality", 0.8, "<", "warning", "m"), ("high", "age", 24.0, ">", "error", "m")]
T0 = dt.datetime(2024, 1, 1)
POINT_SCHEMA = "name string, value double, timestamp timestamp_ntz, event_id bigint"
BAR = (
    "symbol string, exchange string, interval string, datetime timestamp_ntz, open double, high double, low double, close double, "
    "volume double, turnover double, open_interest double, day int, seq int"
)


def plain_lifecycle(points, controls):
    """The changes by one pass over all events in time order."""
    events = []
    for name, value, time, event_id in points:
        for rule, metric, bound, op, level, _ in RULES:
            if metric == name and (value > bound if op == ">" else value < bound):
                events.append((time, event_id, rule, value, level))
    events += [(time, event_id, rule, None, None) for rule, time, event_id, kind in controls if kind == alerts.RESOLVE]
    active, out = {}, []
    for time, event_id, rule, value, level in sorted(events, key=lambda e: e[:2]):
        if value is not None and rule not in active:
            active[rule] = level
            out.append((rule, time, event_id, value, "fired", level))
        elif value is None and rule in active:
            out.append((rule, time, event_id, None, "resolved", active.pop(rule)))
    return sorted(out, key=str)


def events_of(seed, n):
    rng = random.Random(seed)
    points, controls = [], []
    for k in range(n):
        time = T0 + dt.timedelta(minutes=3 * k, seconds=rng.randrange(60), microseconds=rng.randrange(1_000_000))
        if rng.random() < 0.2:
            controls.append((rng.choice(["low", "high", "unknown"]), time, k, alerts.RESOLVE))
        else:
            points.append((rng.choice(["quality", "age", "other"]), rng.choice([0.1, 0.9, 20.0, 30.0]), time, k))
    return points, controls


def test_alerts_survive_restarts_and_disorder(spark):
    points, controls = events_of(1, 240)
    path = sinks.scratch_path(spark, "held")
    far = T0 + dt.timedelta(days=9)
    # Four runs from one checkpoint; inside a run files are in disorder within the delay.
    for run in range(4):
        lo, hi = T0 + dt.timedelta(minutes=180 * run), T0 + dt.timedelta(minutes=180 * (run + 1))
        some = [p for p in points if lo <= p[2] < hi]
        random.Random(run).shuffle(some)
        acts = [c for c in controls if lo <= c[1] < hi] + ([("low", far, -1, alerts.TICK), ("high", far, -1, alerts.TICK)] if run == 3 else [])
        spark.createDataFrame(some, POINT_SCHEMA).repartition(3).write.mode("append").parquet(f"{path}/points")
        spark.createDataFrame(acts, alerts.CONTROL_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/controls")
        changes = alerts.lifecycle(
            jobs.file_stream(spark, f"{path}/points", POINT_SCHEMA), jobs.file_stream(spark, f"{path}/controls", alerts.CONTROL_SCHEMA),
            metrics.rule_table(spark, RULES), delay="200 minutes")
        with alerts.with_rocksdb(spark):
            jobs.run_available(changes, f"{path}/changes", f"{path}/checkpoint")
    got = spark.read.parquet(f"{path}/changes").select("rule", "timestamp", "event_id", "value", "change", "level")
    want = plain_lifecycle(points, controls)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and len(want) > 20


def test_the_state_store_setting_is_put_back(spark):
    before = spark.conf.get(alerts.STORE, None)
    with alerts.with_rocksdb(spark):
        assert spark.conf.get(alerts.STORE) == alerts.ROCKSDB
    assert spark.conf.get(alerts.STORE, None) == before


def bars(spark, rows):
    values = [(s, "SSE", "1m", T0 + dt.timedelta(minutes=m), c, c, c, c, 1.0, c, 0.0, 1, q) for s, m, c, q in rows]
    return spark.createDataFrame(values, BAR)


def arrive(spark, path, rows, checkpoint, cold_rows=3):
    bars(spark, rows).coalesce(1).write.mode("append").parquet(f"{path}/in")
    jobs.upsert_newer(jobs.file_stream(spark, f"{path}/in", BAR), f"{path}/t", checkpoint, ["exchange", "day"], f"{path}/cursor", cold_rows)
    kept = sinks.read_table(spark, f"{path}/t").select("symbol", "datetime", "close").collect()
    return sorted((r["symbol"], (r["datetime"] - T0).seconds // 60, r["close"]) for r in kept)


def test_cursor_takes_only_what_is_newer(spark):
    path = sinks.scratch_path(spark, "cursor")
    one = f"{path}/checkpoint"
    # Cold start: the last three of each series; a repeated time goes to the greater seq.
    first = arrive(spark, path, [("a", m, float(m), 0) for m in range(6)] + [("a", 5, 50.0, 1), ("b", 1, 1.0, 0)], one)
    assert first == [("a", 3, 3.0), ("a", 4, 4.0), ("a", 5, 50.0), ("b", 1, 1.0)]
    # Rows at or before the stored maximum are ignored, a new series starts cold, a known one goes on.
    second = arrive(spark, path, [("a", 4, -1.0, 9), ("a", 5, -1.0, 9), ("a", 7, 7.0, 0), ("c", 0, 0.0, 0), ("b", 2, 2.0, 0), ("b", 2, 2.5, 1)], one)
    assert set(second) == set(first) | {("a", 7, 7.0), ("c", 0, 0.0), ("b", 2, 2.5)}
    # Everything again from a fresh checkpoint: nothing is newer.
    again = arrive(spark, path, [("a", 6, 6.0, 5)], f"{path}/other")
    assert again == second
    cursor = {r["symbol"]: (r["datetime"] - T0).seconds // 60 for r in sinks.read_table(spark, f"{path}/cursor").collect()}
    assert cursor == {"a": 7, "b": 2, "c": 0}


def test_cursor_is_built_from_an_existing_table(spark):
    path = sinks.scratch_path(spark, "stored")
    sinks.write_table(bars(spark, [("a", 3, 3.0, 0)]).drop("seq"), f"{path}/t", ["exchange", "day"])
    assert arrive(spark, path, [("a", 2, 2.0, 0), ("a", 4, 4.0, 0)], f"{path}/checkpoint") == [("a", 3, 3.0), ("a", 4, 4.0)]


def test_a_lost_cursor_write_is_repeated(spark, monkeypatch):
    path = sinks.scratch_path(spark, "lost")
    arrive(spark, path, [("a", 1, 1.0, 0)], f"{path}/checkpoint")
    bars(spark, [("a", 2, 2.0, 0)]).coalesce(1).write.mode("append").parquet(f"{path}/in")
    real = sinks.upsert_table

    def failing(session, to, *a, **kw):
        if to.endswith("cursor"):
            raise RuntimeError("lost")
        return real(session, to, *a, **kw)

    monkeypatch.setattr(sinks, "upsert_table", failing)
    try:
        arrive(spark, path, [("a", 3, 3.0, 0)], f"{path}/checkpoint")
        raise AssertionError
    except Exception as e:  # noqa: BLE001 - the stream wraps it
        assert "lost" in str(e)
    monkeypatch.setattr(sinks, "upsert_table", real)
    assert arrive(spark, path, [("a", 4, 4.0, 0)], f"{path}/checkpoint") == [("a", m, float(m)) for m in (1, 2, 3, 4)]
    assert sinks.read_table(spark, f"{path}/t").groupBy("datetime").count().filter(F.col("count") > 1).count() == 0
