"""Queries of the streaming jobs: run on all arrived files, read the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom import fixed
from tapeloom.operators import metrics
from tapeloom.registry import governance as _governance  # noqa: F401 - defines the SQL of rule changes
from tapeloom.registry.base_sql import define, sql
from tapeloom.registry.common import minutes, on_tables, r, rq
from tapeloom.sinks import tables as sinks
from tapeloom.sources.adapters import Tables
from tapeloom.streaming import alerts, jobs


class _Arriving(Tables):
    """The adapter tables with ``events`` as a file stream."""

    def raw(self, name: str):
        if name != "events":
            return super().raw(name)
        schema = self.spark.read.parquet(f"{self.sf_dir}/events.parquet").schema
        return jobs.file_stream(self.spark, self.sf_dir, schema, "events.parquet")


def _arriving(t: Tables) -> Tables:
    return _Arriving(t.spark, t.sf_dir)


def _sink(t: Tables, name: str, stream):
    path = sinks.scratch_path(t.spark, name)
    jobs.run_available(stream, path, path + "-checkpoint")
    return t.spark.read.parquet(path)


def _upserted(t: Tables):
    """A table of the first twenty days, then the stream brings all of January restated by one."""
    path = sinks.scratch_path(t.spark, "minutes")
    parts = ["exchange", "day"]
    known = minutes(t).filter(F.dayofmonth("datetime") <= 20).withColumn("day", F.dayofmonth("datetime"))
    sinks.write_table(known, path, parts, ["symbol", "datetime"])
    stream = _arriving(t).ticks().filter(F.dayofmonth("datetime") >= 10).withColumn("close", F.col("close") + 1)
    jobs.upsert_batches(stream.withColumn("day", F.dayofmonth("datetime")).withColumn("seq", F.lit(1)), path, path + "-checkpoint", parts, sequence=["seq", "close"])
    return sinks.read_table(t.spark, path)


def _latest(t: Tables):
    path = sinks.scratch_path(t.spark, "latest")
    jobs.upsert_latest(_arriving(t).ticks(), path, path + "-checkpoint")
    return sinks.read_table(t.spark, path)


def _resampled(t: Tables):
    """What the stream puts out, and the buckets still open when it stops."""
    done = _sink(t, "resampled", jobs.resample_stream(_arriving(t).ticks(), "1h"))
    return done.unionByName(jobs.open_buckets(t.ticks(), done, "1h"))


def _twice(t: Tables):
    a = _arriving(t).ticks()
    return a.union(_arriving(t).ticks())


def _alerts(t: Tables):
    path = sinks.scratch_path(t.spark, "alerts")
    jobs.alert_batches(_arriving(t).metrics(), metrics.rule_table(t.spark), path, path + "-checkpoint")
    return t.spark.read.parquet(f"{path}/changes")


def _newer(t: Tables):
    """Ten days of all series but one are stored; the stream restates all of January by one, twice."""
    path = sinks.scratch_path(t.spark, "newer")
    parts = ["exchange", "day"]
    known = minutes(t).filter((F.dayofmonth("datetime") <= 10) & (F.col("symbol") != "signup")).withColumn("day", F.dayofmonth("datetime"))
    sinks.write_table(known, path, parts, ["symbol", "datetime"])
    for run in ("first", "again"):
        stream = _arriving(t).ticks().withColumns({"close": F.col("close") + 1, "day": F.dayofmonth("datetime"), "seq": F.lit(1)})
        jobs.upsert_newer(stream, path, f"{path}-{run}", parts, path + "-cursor", sequence=["seq", "close"])
    return sinks.read_table(t.spark, path)


def _controls(t: Tables):
    """Every point of an unwatched metric resolves one of the rules by hand."""
    names = [rule[0] for rule in fixed.ALERT_RULES]
    rule = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    return t.metrics().filter("name = 'other'").select(rule.alias("rule"), "timestamp", "event_id", F.lit(alerts.RESOLVE).alias("kind"))


def _lifecycle(t: Tables):
    """All events, then from the same checkpoint a tick per rule that lets time run on."""
    path = sinks.scratch_path(t.spark, "lifecycle")
    controls = _controls(t)
    controls.write.parquet(f"{path}/controls")
    for run in ("events", "end"):
        if run == "end":
            end = controls.groupBy("rule").agg((F.max("timestamp") + F.expr("interval 3 days")).alias("timestamp"))
            end.select("rule", "timestamp", F.lit(-1).cast("long").alias("event_id"), F.lit(alerts.TICK).alias("kind")).write.mode("append").parquet(f"{path}/controls")
        stream = jobs.file_stream(t.spark, f"{path}/controls", alerts.CONTROL_SCHEMA)
        changes = alerts.lifecycle(_arriving(t).metrics(), stream, metrics.rule_table(t.spark))
        with alerts.with_rocksdb(t.spark):
            jobs.run_available(changes, f"{path}/changes", f"{path}/checkpoint")
    return t.spark.read.parquet(f"{path}/changes")


define("control_segments", ["metrics", "rules"], """
SELECT *, sum(CAST(kind = 'resolve' AS INT)) OVER (PARTITION BY rule ORDER BY timestamp, event_id) AS segment FROM (
SELECT rule, timestamp, event_id, value, 'point' AS kind, level FROM metrics JOIN rules USING (name)
WHERE CASE op WHEN '>' THEN value > threshold ELSE value < threshold END
UNION ALL SELECT rules.rule, timestamp, event_id, NULL, 'resolve', level FROM metrics JOIN rules
  ON rules.rule = ['@R0@', '@R1@', '@R2@', '@R3@'][CAST(event_id % 4 AS INT) + 1] WHERE metrics.name = 'other')""".replace(
    "@R0@", fixed.ALERT_RULES[0][0]).replace("@R1@", fixed.ALERT_RULES[1][0]).replace("@R2@", fixed.ALERT_RULES[2][0]).replace("@R3@", fixed.ALERT_RULES[3][0]))

QUERIES = {
    "stream_minute_cursor": on_tables(lambda t: _newer(t).select("symbol", "datetime", "close")),
    "stream_alert_lifecycle": on_tables(lambda t: _lifecycle(t).select("rule", "timestamp", "value", "change", "level")),
    "stream_minute_upsert": on_tables(lambda t: _upserted(t).select("symbol", "datetime", "close")),
    "stream_dedup": on_tables(lambda t: _sink(t, "dedup", jobs.dedup(_twice(t), ["symbol", "close"])).select("symbol", "datetime", "close")),
    "stream_resample": on_tables(lambda t: _resampled(t).select(
        "symbol", "datetime", "open", "high", "low", "close", "volume", r("turnover", 4))),
    "stream_latest": on_tables(lambda t: _latest(t).select("symbol", "datetime", "close")),
    "stream_alerts": on_tables(lambda t: _alerts(t).select("rule", "timestamp", "value", "change", "level")),
}

ORACLE = {
    "stream_minute_cursor": sql(
        "WITH m AS (SELECT symbol, datetime, max(close) AS close FROM ticks GROUP BY symbol, datetime) "
        "SELECT symbol, datetime, close FROM m WHERE day(datetime) <= 10 AND symbol <> 'signup' UNION ALL SELECT symbol, datetime, close + 1 FROM (SELECT *, "
        "row_number() OVER (PARTITION BY symbol ORDER BY datetime DESC) AS rn FROM m) WHERE CASE WHEN symbol = 'signup' THEN rn <= 100 ELSE day(datetime) > 10 END",
        "ticks"),
    "stream_alert_lifecycle": sql(
        "SELECT rule, min(timestamp) AS timestamp, arg_min(value, (timestamp, event_id)) AS value, 'fired' AS change, min(level) AS level FROM control_segments "
        "WHERE kind = 'point' GROUP BY rule, segment UNION ALL SELECT c.rule, c.timestamp, NULL, 'resolved', c.level FROM control_segments c "
        "JOIN (SELECT DISTINCT rule, segment FROM control_segments WHERE kind = 'point') f ON c.rule = f.rule AND c.segment = f.segment + 1 "
        "WHERE c.kind = 'resolve'", "control_segments"),
    "stream_minute_upsert": sql(
        "SELECT symbol, datetime, CASE WHEN day(datetime) >= 10 THEN max(close) + 1 ELSE max(close) END AS close FROM ticks GROUP BY symbol, datetime", "ticks"),
    "stream_dedup": sql("SELECT DISTINCT symbol, datetime, close FROM ticks", "ticks"),
    "stream_resample": sql(
        "SELECT symbol, h AS datetime, arg_min(open, datetime) AS open, max(high) AS high, min(low) AS low, arg_max(close, datetime) AS close, "
        f"sum(volume) AS volume, {rq('sum(turnover)', 4, 'turnover')} FROM (SELECT *, CAST(date_trunc('hour', datetime) AS TIMESTAMP) AS h FROM ticks) "
        "GROUP BY symbol, h", "ticks"),
    "stream_latest": sql("SELECT symbol, max(datetime) AS datetime, arg_max(close, datetime) AS close FROM ticks GROUP BY 1", "ticks"),
    "stream_alerts": sql("SELECT rule, timestamp, value, change, level FROM changes", "changes"),
}
