"""Queries of the quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators import layers, quality
from tapeloom.registry import series as _series  # noqa: F401 - defines the SQL of returns
from tapeloom.registry.base_sql import define, sql
from tapeloom.registry.common import on_tables, r, rq
from tapeloom.registry.layers import ISSUES, TURNOVER, dirty
from tapeloom.session import materialize

K = "exchange, symbol"
NUM = quality.NUMERIC
COLS = ["datetime", *NUM]


def _out(df):
    return df.select("exchange", "symbol", "rule_name", "issue_type", "severity", "column", "affected_records", "total_records", r("rate", 9))


def _sev(limit: float) -> str:
    return f"CASE WHEN 1 - b / n < {limit} THEN 'critical' ELSE 'poor' END"


def _issue(rule: str, kind: str, col: str, count: str, sev: str, source: str = "dirty", total: str = "count(*)") -> str:
    return (f"SELECT {K}, '{rule}' AS rule_name, '{kind}' AS issue_type, {sev} AS severity, {col} AS \"column\", CAST(b AS BIGINT) AS affected_records, "
            f"CAST(n AS BIGINT) AS total_records, round(1 - b / n, 9) + 0 AS rate FROM (SELECT {K}, {count} AS b, {total} AS n FROM {source} GROUP BY 1, 2) WHERE b > 0")


def _union(parts):
    return " UNION ALL ".join(parts)


_COMPLETE = _union(_issue("missing_values", "completeness", f"'{c}'", f"count(*) FILTER ({c} IS NULL)", _sev(0.8)) for c in COLS)
_ACCURATE = _issue("price_relationship", "accuracy", "CAST(NULL AS VARCHAR)",
                   "count(*) FILTER (NOT coalesce(low <= open AND open <= high AND low <= close AND close <= high, false))", _sev(0.9))
_NEGATIVE = _union(_issue("negative_values", "validity", f"'{c}'", f"count(*) FILTER ({c} < 0)", _sev(0.9)) for c in NUM)
define("gaps", ["dirty"], f"""
SELECT {K}, date_diff('microsecond', lag(datetime) OVER (PARTITION BY {K} ORDER BY datetime), datetime) AS gap FROM dirty""")
define("gap_modes", ["gaps"], f"""
SELECT {K}, gap AS mode FROM (SELECT {K}, gap, row_number() OVER (PARTITION BY {K} ORDER BY count(*) DESC, gap) AS rn
FROM gaps WHERE gap IS NOT NULL GROUP BY {K}, gap) WHERE rn = 1""")
_CONSISTENT = _issue("time_consistency", "consistency", "CAST(NULL AS VARCHAR)", "count(*) FILTER (abs(gap - mode) > mode * 0.5)",
                     "CASE WHEN 1 - b / n < 0.95 THEN 'poor' ELSE 'fair' END",
                     "(SELECT * FROM gaps JOIN gap_modes USING (exchange, symbol) WHERE gap IS NOT NULL AND mode > 0)")
_OUTLIER = _union(_issue(
    "outliers", "validity", f"'{c}'", f"count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))",
    "CASE WHEN 1 - b / n > 0.9 THEN 'fair' ELSE 'poor' END",
    f"(SELECT * FROM dirty JOIN (SELECT {K}, quantile_cont({c}, 0.25e0) AS q1, quantile_cont({c}, 0.75e0) AS q3 FROM dirty GROUP BY 1, 2) USING (exchange, symbol))",
) for c in NUM)
define("issues", ["gaps", "gap_modes"], _union([_COMPLETE, _ACCURATE, _NEGATIVE, _CONSISTENT, _OUTLIER]))
_TYPES = quality.TYPES


def _metrics(t):
    bars = materialize(dirty(t))
    return quality.metrics(quality.validate(bars), bars).select(
        "exchange", "symbol", "total_records", *[r(c, 9) for c in _TYPES], r("overall_score", 9), "quality_level")


WEIGHTS = {"missing_values": 3.0, "price_relationship": 2.0, "negative_values": 1.0, "traded": 2.0}


def _weighted(t):
    """Three rules of the table and one of the user, weighted."""
    bars = materialize(dirty(t))
    issues = quality.completeness(bars, columns=COLS).unionByName(quality.accuracy(bars)).unionByName(quality.negative(bars)).unionByName(
        quality.custom_rule(bars, "traded", "validity", F.col("volume") > 5))
    return quality.weighted_score(issues, bars, WEIGHTS)


def _gappy_prices(t):
    """Prices without a close on even days, those of the first of a month twice."""
    gaps = t.prices().select("symbol", "trade_date", F.when(F.dayofmonth("trade_date") % 2 == 1, F.col("close")).alias("close"), "volume")
    return gaps.union(gaps.filter(F.dayofmonth("trade_date") == 1))


QUERIES = {
    "dq_completeness": on_tables(lambda t: _out(quality.completeness(dirty(t), columns=COLS))),
    "dq_accuracy": on_tables(lambda t: _out(quality.accuracy(dirty(t)))),
    "dq_consistency": on_tables(lambda t: _out(quality.consistency(dirty(t)))),
    "dq_negative": on_tables(lambda t: _out(quality.negative(dirty(t)))),
    "dq_iqr_outliers": on_tables(lambda t: _out(quality.iqr_outliers(dirty(t)))),
    "dq_validate": on_tables(lambda t: _out(quality.validate(materialize(dirty(t))))),
    "dq_metrics": on_tables(_metrics),
    "dq_recommend": on_tables(lambda t: quality.recommend(quality.validate(materialize(dirty(t)))).select(
        "exchange", "symbol", F.array_join("recommendations", "|").alias("advice"))),
    "dq_financial": on_tables(lambda t: _out(quality.completeness(
        t.financials().withColumn("net_profit", F.when(F.month("report_date") != 6, F.col("net_profit"))),
        columns=["report_date", "revenue", "net_profit", "total_assets"]))),
    "dq_weighted_rules": on_tables(lambda t: _weighted(t).select("exchange", "symbol", "total_records", r("weighted_score", 9))),
    "dq_custom_rule": on_tables(lambda t: _out(quality.custom_rule(dirty(t), "traded", "validity", F.col("volume") > 5))),
    "dq_ods_bar": on_tables(lambda t: quality.score_ods_bars(dirty(t)).select(
        "exchange", "symbol", "datetime", r("quality_score", 3), "is_valid", F.array_join("issues", ";").alias("issues"))),
    "dq_dwd_bar": on_tables(lambda t: quality.score_dwd_bars(layers.dwd_bars(layers.ods_bars(dirty(t), "lake")).drop("is_valid")).select(
        "exchange", "symbol", "datetime", r("quality_score", 3), "is_valid", F.array_join("issues", ";").alias("issues"))),
    "dq_dws_adjusted": on_tables(lambda t: quality.score_dws_adjusted(
        layers.dws_adjusted(layers.dwd_bars(layers.ods_bars(t.bars(), "lake")), t.adj_factor()).withColumn(
            "hfq_factor", F.when(F.dayofmonth("datetime") == 4, 0.0).otherwise(F.col("hfq_factor")))).select(
        "exchange", "symbol", "datetime", r("quality_score", 3), "is_valid", F.array_join("issues", ";").alias("issues"))),
    "dq_frame": on_tables(lambda t: quality.check_frame(t.prices(), "price").union(
        quality.check_frame(t.fundamentals().withColumnRenamed("date", "trade_date").drop("exchange"), "fundamental")).union(
        quality.check_frame(_gappy_prices(t), "price").withColumn("data_type", F.lit("price_with_gaps")))),
    "dq_anomaly": on_tables(lambda t: quality.anomalies(t.bars()).select(
        "exchange", "symbol", "datetime", "type", "value", r("change_rate", 7), "severity")),
    "schema_check": on_tables(lambda t: quality.schema_check(t.bars(), T.StructType([
        T.StructField("symbol", T.StringType()), T.StructField("exchange", T.StringType()), T.StructField("interval", T.StringType()),
        T.StructField("datetime", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")],
        T.StructField("volume", T.LongType()), T.StructField("turnover", T.DoubleType()), T.StructField("amount", T.DoubleType())]))),
}

_COLS_OUT = "exchange, symbol, datetime, round(1 - {n} / 10, 3) AS quality_score, {n} = 0 AS is_valid, issues"
_N = "(CASE WHEN issues = '' THEN 0 ELSE len(string_split(issues, ';')) END)"
_SUMS = ", ".join(f"sum(affected_records) FILTER (issue_type = '{t}') AS s_{t}" for t in _TYPES)
_RATES = ", ".join(f"CASE WHEN k IS NULL THEN 1e0 WHEN s_{t} IS NULL THEN 0e0 ELSE 1 - s_{t} / n END AS {t}" for t in _TYPES)
_MEAN = ("(" + " + ".join(f"CASE WHEN {t} > 0 THEN {t} ELSE 0 END" for t in _TYPES) + ") / nullif("
         + " + ".join(f"CASE WHEN {t} > 0 THEN 1 ELSE 0 END" for t in _TYPES) + ", 0)")
ORACLE = {
    "dq_completeness": sql(_COMPLETE, "dirty"), "dq_accuracy": sql(_ACCURATE, "dirty"), "dq_negative": sql(_NEGATIVE, "dirty"),
    "dq_consistency": sql(_CONSISTENT, "gaps", "gap_modes"), "dq_iqr_outliers": sql(_OUTLIER, "dirty"),
    "dq_validate": sql("SELECT * FROM issues", "issues"),
    "dq_metrics": sql(
        f"SELECT {K}, n AS total_records, " + ", ".join(rq(t, 9, t) for t in _TYPES) + f", {rq('o', 9, 'overall_score')}, CASE WHEN o >= 0.95 THEN 'excellent' "
        "WHEN o >= 0.85 THEN 'good' WHEN o >= 0.70 THEN 'fair' WHEN o >= 0.50 THEN 'poor' ELSE 'critical' END AS quality_level FROM ("
        f"SELECT *, {_MEAN} AS o FROM (SELECT {K}, n, {_RATES} FROM (SELECT {K}, count(*) AS n FROM dirty GROUP BY 1, 2) LEFT JOIN "
        f"(SELECT {K}, count(*) AS k, {_SUMS} FROM issues GROUP BY 1, 2) USING (exchange, symbol)))", "dirty", "issues"),
    "dq_recommend": sql(
        f"SELECT {K}, concat_ws('|', CASE WHEN bool_or(severity = 'critical') THEN '@ADVICE_CRITICAL@' END, CASE WHEN bool_or(severity = 'poor') "
        "THEN '@ADVICE_POOR@' END, CASE WHEN bool_or(issue_type = 'completeness') THEN '@ADVICE_COMPLETENESS@' END, "
        "CASE WHEN bool_or(issue_type = 'accuracy') THEN '@ADVICE_ACCURACY@' END) AS advice FROM issues GROUP BY 1, 2", "issues"),
    "dq_financial": sql(_issue("missing_values", "completeness", "'net_profit'", "count(*) FILTER (month(report_date) = 6)", _sev(0.8), "financials"), "financials"),
    "dq_weighted_rules": sql(
        f"SELECT {K}, n AS total_records, round((" + " + ".join(f"coalesce(r_{k}, 1) * {w}e0" for k, w in WEIGHTS.items())
        + f") / {sum(WEIGHTS.values())}e0, 9) + 0 AS weighted_score FROM (SELECT {K}, count(*) AS n FROM dirty GROUP BY 1, 2) LEFT JOIN (SELECT {K}, "
        + ", ".join(f"min(rate) FILTER (rule_name = '{k}') AS r_{k}" for k in WEIGHTS) + " FROM (" + _union([
            _COMPLETE, _ACCURATE, _NEGATIVE, _issue("traded", "validity", "CAST(NULL AS VARCHAR)", "count(*) FILTER (NOT volume > 5)", _sev(0.95))])
        + ") GROUP BY 1, 2) USING (exchange, symbol)", "dirty"),
    "dq_custom_rule": sql(_issue("traded", "validity", "CAST(NULL AS VARCHAR)", "count(*) FILTER (NOT volume > 5)", _sev(0.95)), "dirty"),
    "dq_ods_bar": sql(f"SELECT {_COLS_OUT.format(n=_N)} FROM (SELECT *, {ISSUES.format(TURNOVER)} AS issues FROM dirty)", "dirty"),
    "dq_dwd_bar": sql(
        f"SELECT {_COLS_OUT.format(n=_N)} FROM (SELECT *, concat_ws(';', CASE WHEN v <= 0 THEN '@BAD_VWAP@' END, CASE WHEN volume * close <= 0 THEN '@BAD_TURNOVER@' END) "
        "AS issues FROM (SELECT *, CASE WHEN volume = 0 THEN close ELSE (open + high + low + close) / 4 END AS v FROM dirty))", "dirty"),
    "dq_dws_adjusted": sql(
        f"SELECT {_COLS_OUT.format(n=_N)} FROM (SELECT *, CASE WHEN day(datetime) = 4 THEN '@BAD_HFQ@' ELSE '' END AS issues FROM bars)", "bars"),
    "dq_frame": sql(
        "SELECT 'price' AS data_type, count(*) AS total_records, false AS many_missing, false AS has_duplicates, count(*) FILTER (close <= 0) AS non_positive, "
        "count(*) FILTER (close <= 0) = 0 AS passed FROM prices UNION ALL SELECT 'fundamental', count(*), false, false, count(*) FILTER (pe_ttm <= 0), "
        "count(*) FILTER (pe_ttm <= 0) = 0 FROM fundamentals UNION ALL SELECT 'price_with_gaps', count(*), (count(*) - count(close)) / (4e0 * count(*)) > 0.1e0, "
        "count(*) > count(DISTINCT (symbol, trade_date)), count(*) FILTER (close <= 0), count(*) FILTER (close <= 0) = 0 FROM "
        "(SELECT symbol, trade_date, CASE WHEN day(trade_date) % 2 = 1 THEN close END AS close FROM (SELECT * FROM prices UNION ALL "
        "SELECT * FROM prices WHERE day(trade_date) = 1))", "prices", "fundamentals"),
    "dq_anomaly": sql(
        f"SELECT {K}, datetime, 'price_spike' AS type, close AS value, {rq('ret', 7, 'change_rate')}, CASE WHEN abs(ret) > 5 * s THEN 'high' ELSE 'medium' END AS severity "
        f"FROM (SELECT *, avg(ret) OVER (PARTITION BY {K}) AS m, stddev_samp(ret) OVER (PARTITION BY {K}) AS s FROM rets) WHERE abs(ret - m) > 3 * s", "rets"),
    "schema_check": sql(
        "SELECT * FROM (VALUES ('amount', 'missing_field', 'error'), ('open_interest', 'extra_field', 'warning'), ('volume', 'type_mismatch', 'warning')) "
        "v(\"column\", issue, severity), (SELECT count(*) AS total_records FROM bars)", "bars"),
}
