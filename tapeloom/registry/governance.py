"""Queries of lineage, retention, audit, metrics and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom import fixed
from tapeloom.operators import events, lineage, metrics, retention
from tapeloom.registry.base_sql import define, sql
from tapeloom.registry.common import on_tables, r, rq

TODAY, NOW = "2001-08-01", "2024-01-30 12:00:00"

define("closure", ["lineage_edges"], """
SELECT source_id AS root, target_id AS node FROM lineage_edges
UNION SELECT a.source_id, b.target_id FROM lineage_edges a JOIN lineage_edges b ON a.target_id = b.source_id
UNION SELECT a.source_id, c.target_id FROM lineage_edges a JOIN lineage_edges b ON a.target_id = b.source_id
  JOIN lineage_edges c ON b.target_id = c.source_id""")
define("impact", ["closure", "lineage_edges"], """
SELECT node_id, count(*) FILTER (k = 1) AS direct_impact, count(*) FILTER (k = 2) AS total_impact,
  count(*) FILTER (k = 3) AS dependencies, count(*) FILTER (k = 4) AS total_dependencies
FROM (SELECT source_id AS node_id, 1 AS k FROM lineage_edges UNION ALL SELECT root, 2 FROM closure
  UNION ALL SELECT target_id, 3 FROM lineage_edges UNION ALL SELECT node, 4 FROM closure) GROUP BY 1""")
define("rules", [], """
SELECT * FROM (VALUES """ + ", ".join(f"('{rule}', '{name}', {bound}e0, '{op}', '{level}')" for rule, name, bound, op, level, _ in fixed.ALERT_RULES) + """)
v(rule, name, threshold, op, level)""")
define("changes", ["metrics", "rules"], """
SELECT * FROM (SELECT *, CASE WHEN breach AND NOT before THEN 'fired' WHEN NOT breach AND before THEN 'resolved' END AS change FROM (
SELECT *, coalesce(lag(breach) OVER (PARTITION BY rule ORDER BY timestamp, event_id), false) AS before FROM (
SELECT m.*, rule, threshold, level, CASE op WHEN '>' THEN value > threshold ELSE value < threshold END AS breach
FROM metrics m JOIN rules USING (name)))) WHERE change IS NOT NULL""")


def _expiry(t):
    return retention.with_expiry(t.assets(), retention.policy_table(t.spark), TODAY)


def _providers(t):
    key = F.col("s_suppkey")
    provider = F.when(key % 3 == 0, "akshare").when(key % 3 == 1, "tushare").otherwise("yfinance")
    return t.raw("supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), provider.alias("provider"),
                                    F.concat(F.lit("bars_"), F.col("s_suppkey").cast("string")).alias("dataset_id"))


_PROVIDER = "CASE s_suppkey % 3 WHEN 0 THEN 'akshare' WHEN 1 THEN 'tushare' ELSE 'yfinance' END"


def _worsened(t):
    """Metrics at ten times their level, quality at a tenth of it."""
    value = F.col("value")
    return t.metrics().withColumn("value", F.when(F.col("name") == "data_quality_score", value / 10).otherwise(value * 10))


def _alerts(t):
    fired = metrics.alerts(metrics.transitions(t.metrics(), metrics.rule_table(t.spark)))
    return fired.withColumn("acknowledged", F.col("event_id") % 2 == 0)


def _paths(t):
    edges = t.lineage_edges()
    regions = t.raw("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"))
    customers = t.raw("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"))
    return lineage.paths(edges, regions, customers).select("source_id", "target_id", F.array_join("path", ">").alias("path"))


def _fresh(t):
    parts = [metrics.freshness(t.ticks(), "ticks", "datetime", NOW), metrics.freshness(t.metrics(), "metrics", "timestamp", NOW),
             metrics.freshness(t.bars(), "bars", "datetime", NOW), metrics.freshness(t.news(), "news", "publish_date", NOW)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("dataset", "last_time", r("age_hours", 6))


QUERIES = {
    "lineage_neighbors": on_tables(lambda t: lineage.neighbors(t.lineage_edges())),
    "lineage_closure": on_tables(lambda t: lineage.closure(t.lineage_edges())),
    "lineage_paths": on_tables(_paths),
    "lineage_impact": on_tables(lambda t: lineage.impact(t.lineage_edges())),
    "dataset_impact": on_tables(lambda t: lineage.dataset_impact(
        t.lineage_nodes(), t.lineage_edges()).select(
        "dataset_id", "node_id", "direct_impact", "total_impact", "dependencies", "total_dependencies", "affected_datasets",
        F.array_join("recommendations", "|").alias("advice"))),
    "provider_impact": on_tables(lambda t: lineage.provider_impact(lineage.datasets_of_provider(_providers(t), "share")).select(
        "provider", "total_impact", F.array_join("recommendations", "|").alias("advice"))),
    "lineage_edges": on_tables(lambda t: lineage.chain_edges(_providers(t))),
    "lineage_report": on_tables(lambda t: lineage.lineage_report(t.lineage_nodes(), t.lineage_edges())),
    "retention_expired": on_tables(lambda t: _expiry(t).select("asset_id", "policy_id", "expires_at", "is_expired", "status")),
    "compliance_summary": on_tables(lambda t: retention.compliance_summary(_expiry(t))),
    "audit_search": on_tables(lambda t: events.audit_by(t.audit(), kind="error").filter(
        F.col("timestamp").between(F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))).select(
        "event_id", "timestamp", "user_id", "asset_id", "details")),
    "metric_stats": on_tables(lambda t: metrics.statistics(metrics.trailing(t.metrics(), NOW, "10 days")).select(
        "name", "count", "min", "max", r("mean", 7), "latest")),
    "alert_rules": on_tables(lambda t: metrics.firing(_worsened(t), metrics.rule_table(t.spark)).select("rule", "name", "level", "value", "threshold")),
    "alert_transitions": on_tables(lambda t: metrics.transitions(t.metrics(), metrics.rule_table(t.spark)).select(
        "rule", "timestamp", "value", "change", "level")),
    "alert_stats": on_tables(lambda t: metrics.alert_stats(_alerts(t))),
    "health_status": on_tables(lambda t: metrics.health(t.metrics()).select("component", "name", "value", "status")),
    "health_by_rule": on_tables(lambda t: metrics.health_by(t.metrics(), {
        "api_error_rate": lambda v: F.when(v < 0.05, "healthy").otherwise("degraded"),
        "data_age_hours": lambda v: F.when(v > 5, "unhealthy").otherwise("healthy"),
    })),
    "metric_history": on_tables(lambda t: metrics.history(t.metrics(), 1000, NOW, "10 days").select("name", "timestamp", "value")),
    "freshness": on_tables(_fresh),
}


def _age(name: str, table: str, time: str) -> str:
    whole = f"trunc((epoch_us(TIMESTAMP '{NOW}') - epoch_us(m)) / 1000000e0)"
    return f"SELECT '{name}' AS dataset, m AS last_time, {rq(f'{whole} / 3600', 6, 'age_hours')} FROM (SELECT max({time}) AS m FROM {table})"


ORACLE = {
    "health_by_rule": sql(
        "SELECT name, value, CASE WHEN name = 'api_error_rate' THEN CASE WHEN value < 0.05e0 THEN 'healthy' ELSE 'degraded' END "
        "WHEN value > 5 THEN 'unhealthy' ELSE 'healthy' END AS status FROM (SELECT name, arg_max(value, (timestamp, event_id)) AS value "
        "FROM metrics WHERE name IN ('api_error_rate', 'data_age_hours') GROUP BY 1)", "metrics"),
    "lineage_neighbors": sql(
        "SELECT DISTINCT * FROM (SELECT target_id AS node_id, 'upstream' AS direction, source_id AS neighbor FROM lineage_edges UNION ALL "
        "SELECT source_id, 'downstream', target_id FROM lineage_edges)", "lineage_edges"),
    "lineage_closure": sql("SELECT root, node FROM closure", "closure"),
    "lineage_paths": sql(
        "SELECT a.source_id, b.target_id, a.source_id || '>' || a.target_id || '>' || b.target_id AS path FROM lineage_edges a JOIN lineage_edges b "
        "ON a.target_id = b.source_id WHERE a.source_id LIKE 'r%' AND b.target_id LIKE 'c%'", "lineage_edges"),
    "lineage_impact": sql("SELECT * FROM impact", "impact"),
    "dataset_impact": sql(
        "SELECT dataset_id, s.node_id, coalesce(direct_impact, 0) AS direct_impact, coalesce(total_impact, 0) AS total_impact, coalesce(dependencies, 0) AS "
        "dependencies, coalesce(total_dependencies, 0) AS total_dependencies, coalesce(n, 0) AS affected_datasets, concat_ws('|', CASE WHEN total_impact > 10 THEN "
        "'@ADVICE_WIDE_IMPACT@' END, CASE WHEN total_dependencies > 5 THEN '@ADVICE_MANY_DEPENDENCIES@' END, "
        "CASE WHEN coalesce(direct_impact, 0) = 0 THEN '@ADVICE_UNUSED@' END) AS advice FROM (SELECT dataset_id, min(node_id) AS node_id "
        "FROM lineage_nodes WHERE node_type = 'store' GROUP BY 1) s LEFT JOIN impact i ON s.node_id = i.node_id LEFT JOIN (SELECT root, count(DISTINCT dataset_id) AS n "
        "FROM closure JOIN lineage_nodes ON node = node_id GROUP BY 1) a ON s.node_id = a.root", "impact", "closure", "lineage_nodes"),
    "provider_impact": sql(
        f"SELECT provider, count(*) AS total_impact, CASE WHEN count(*) > 20 THEN '@ADVICE_PROVIDER_WIDE@' ELSE '' END AS advice FROM "
        f"(SELECT {_PROVIDER} AS provider FROM supplier) WHERE provider LIKE '%share%' GROUP BY 1"),
    "lineage_edges":
        f"SELECT symbol, provider, step, CASE step WHEN 1 THEN 'source_' || symbol WHEN 2 THEN 'provider_' || provider ELSE 'service_bars_' || symbol END AS source_id, "
        f"CASE step WHEN 1 THEN 'provider_' || provider WHEN 2 THEN 'service_bars_' || symbol ELSE 'store_bars_' || symbol END AS target_id FROM (SELECT CAST(s_suppkey AS VARCHAR) "
        f"AS symbol, {_PROVIDER} AS provider FROM supplier), (VALUES (1), (2), (3)) v(step)",
    "lineage_report": sql(
        "SELECT dataset_id, count(*) AS nodes_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS edges_count FROM lineage_nodes LEFT JOIN (SELECT source_id, count(*) AS n "
        "FROM lineage_edges GROUP BY 1) ON node_id = source_id GROUP BY 1", "lineage_nodes", "lineage_edges"),
    "retention_expired": sql(
        f"SELECT asset_id, policy_id, expires_at, coalesce(expires_at < TIMESTAMP '{TODAY}', false) AS is_expired, CASE WHEN expires_at < TIMESTAMP '{TODAY}' THEN 'warning' "
        "ELSE 'passed' END AS status FROM (SELECT *, created_at + to_days(CASE policy_id WHEN 'years_7' THEN 2555 WHEN 'years_1' THEN 365 WHEN 'days_30' THEN 30 END) "
        "AS expires_at FROM assets)", "assets"),
    "compliance_summary": sql(
        f"SELECT count(*) AS total_checks, count(*) FILTER (NOT e) AS passed_checks, 0 AS failed_checks, count(*) FILTER (e) AS warning_checks FROM (SELECT coalesce(created_at "
        f"+ to_days(CASE policy_id WHEN 'years_7' THEN 2555 WHEN 'years_1' THEN 365 WHEN 'days_30' THEN 30 END) < TIMESTAMP '{TODAY}', false) AS e FROM assets)", "assets"),
    "audit_search": sql(
        "SELECT event_id, timestamp, user_id, asset_id, details FROM audit WHERE event_type = 'error' AND timestamp BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'",
        "audit"),
    "metric_stats": sql(
        f"SELECT name, count(*) AS count, min(value) AS min, max(value) AS max, {rq('avg(value)', 7, 'mean')}, arg_max(value, (timestamp, event_id)) AS latest FROM metrics "
        f"WHERE timestamp >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY GROUP BY 1", "metrics"),
    "alert_rules": sql(
        "SELECT rule, name, level, value, threshold FROM (SELECT name, CASE name WHEN 'data_quality_score' THEN v / 10 ELSE v * 10 END AS value FROM "
        "(SELECT name, arg_max(value, (timestamp, event_id)) AS v FROM metrics GROUP BY 1)) JOIN rules USING (name) "
        "WHERE CASE op WHEN '>' THEN value > threshold ELSE value < threshold END", "metrics", "rules"),
    "alert_transitions": sql("SELECT rule, timestamp, value, change, level FROM changes", "changes"),
    "alert_stats": sql(
        "SELECT level, count(*) AS total, count(*) FILTER (event_id = last) AS active, count(*) FILTER (event_id % 2 = 0) AS acknowledged FROM (SELECT *, "
        "last_value(event_id) OVER (PARTITION BY rule ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM changes) "
        "WHERE change = 'fired' GROUP BY 1", "changes"),
    "health_status": sql(
        "SELECT component, name, value, CASE WHEN value IS NULL THEN 'unhealthy' WHEN up THEN CASE WHEN value >= h THEN 'healthy' WHEN value >= d THEN 'degraded' "
        "ELSE 'unhealthy' END WHEN value < h THEN 'healthy' WHEN value < d THEN 'degraded' ELSE 'unhealthy' END AS status FROM (VALUES "
        "('data_service', 'data_quality_score', 0.9e0, 0.7e0, true), ('storage_service', 'storage_usage_percent', 80e0, 90e0, false), "
        "('provider_service', 'api_error_rate', 0.05e0, 0.1e0, false)) c(component, name, h, d, up) LEFT JOIN (SELECT name, arg_max(value, (timestamp, event_id)) AS value "
        "FROM metrics GROUP BY 1) USING (name)", "metrics"),
    "metric_history": sql(
        "SELECT name, timestamp, value FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY timestamp DESC, event_id DESC) AS rn FROM metrics) WHERE rn <= 1000 "
        f"AND timestamp >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY", "metrics"),
    "freshness": sql(" UNION ALL ".join([
        _age("ticks", "ticks", "datetime"), _age("metrics", "metrics", "timestamp"), _age("bars", "bars", "datetime"), _age("news", "news", "publish_date")]),
        "ticks", "metrics", "bars", "news"),
}
