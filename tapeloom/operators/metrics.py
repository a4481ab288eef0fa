"""Metric series, alert rules and health checks.

A metric may hold a third of all points: histories are pruned before the shuffle, and the
previous state of a metric is carried over time chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom import fixed
from tapeloom.functions.carry import with_previous
from tapeloom.sources.scans import newest_rows


def rule_table(spark: SparkSession, rules: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(
        rules or fixed.ALERT_RULES, "rule string, name string, threshold double, op string, level string, message string"
    )


def trailing(metrics: DataFrame, now: str, span: str, time: str = "timestamp") -> DataFrame:
    t = F.lit(now).cast("timestamp_ntz")
    return metrics.filter(F.col(time) >= t - F.expr(f"interval {span}"))


def history(metrics: DataFrame, points: int = 1000, now: str | None = None, span: str | None = None) -> DataFrame:
    """The newest points of every metric, optionally of a trailing time span."""
    kept = newest_rows(metrics, points, ["name"], ["timestamp", "event_id"])
    return trailing(kept, now, span) if span else kept


def latest(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("name").agg(F.max_by("value", F.struct("timestamp", "event_id")).alias("value"))


def statistics(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("name").agg(
        F.count("*").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.max_by("value", F.struct("timestamp", "event_id")).alias("latest"),
    )


def breached() -> Column:
    over = (F.col("op") == ">") & (F.col("value") > F.col("threshold"))
    return over | ((F.col("op") == "<") & (F.col("value") < F.col("threshold")))


def firing(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules whose latest metric breaks the threshold."""
    return latest(metrics).join(rules, "name").filter(breached())


def transitions(metrics: DataFrame, rules: DataFrame, chunk: str = "1 minute") -> DataFrame:
    """Rows on which a rule starts (fired) or stops (resolved) being broken."""
    judged = metrics.join(rules, "name").withColumn("breach", breached())
    seen = with_previous(judged, ["rule"], ["timestamp", "event_id"], ["breach"], chunk)
    before = F.coalesce("prev_breach", F.lit(False))
    change = F.when(F.col("breach") & ~before, "fired").when(~F.col("breach") & before, "resolved")
    return seen.withColumn("change", change).filter(F.col("change").isNotNull()).drop("prev_breach")


def alerts(changes: DataFrame) -> DataFrame:
    """Fired alerts; an alert is active when no later change of its rule exists."""
    last = changes.groupBy("rule").agg(F.max_by("event_id", F.struct("timestamp", "event_id")).alias("_last"))
    fired = changes.filter("change = 'fired'").join(last, "rule")
    return fired.withColumn("is_active", F.col("event_id") == F.col("_last")).drop("_last", "change")


def alert_stats(alerts_: DataFrame) -> DataFrame:
    return alerts_.groupBy("level").agg(
        F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.count_if("acknowledged").alias("acknowledged")
    )


def health(metrics: DataFrame, checks: list[tuple] | None = None) -> DataFrame:
    """Status per component from the latest metric; a missing metric is unhealthy."""
    table = metrics.sparkSession.createDataFrame(
        checks or fixed.HEALTH_CHECKS, "component string, name string, healthy double, degraded double, op string"
    )
    v, up = F.col("value"), F.col("op") == ">="

    def within(bound: str) -> Column:
        return F.when(up, v >= F.col(bound)).otherwise(v < F.col(bound))

    status = F.when(v.isNull(), "unhealthy").when(within("healthy"), "healthy").when(within("degraded"), "degraded")
    # One row per metric name against a handful of checks.
    return table.join(latest(metrics), "name", "left").select("component", "name", "value", status.otherwise("unhealthy").alias("status"))


def health_by(metrics: DataFrame, checks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Status per metric name by the caller's rule: from the latest value to a status; a missing metric is unhealthy."""
    names = metrics.sparkSession.createDataFrame([(name,) for name in checks], "name string")
    status = F.lit("unhealthy")
    for name, rule in checks.items():
        status = F.when((F.col("name") == name) & F.col("value").isNotNull(), rule(F.col("value"))).otherwise(status)
    return names.join(latest(metrics), "name", "left").select("name", "value", status.alias("status"))


def freshness(df: DataFrame, dataset: str, time: str, now: str) -> DataFrame:
    """Hours since the newest row of a dataset."""
    t = F.lit(now).cast("timestamp_ntz")
    hours = F.timestamp_diff("SECOND", F.col("last_time"), t) / 3600
    newest = df.agg(F.max(F.col(time).cast("timestamp_ntz")).alias("last_time"))
    return newest.select(F.lit(dataset).alias("dataset"), "last_time", hours.alias("age_hours"))
