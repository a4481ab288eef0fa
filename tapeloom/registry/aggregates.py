"""Queries of resampling, summaries and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import profile, resample, summaries
from tapeloom.plans import pipelines
from tapeloom.registry.base_sql import sql
from tapeloom.registry.common import on_tables, r, rq
from tapeloom.registry.joins import CODES
from tapeloom.session import materialize

# Means and sums of prices in 1/32 of a cent often end in an exact 5. Both engines round such a
# column on a grid moved by this much, so summation noise does not sit on a rounding edge.
OFF_TIE = "1.2345678e-4"


def off_tie(c: str, digits: int):
    return (F.round(F.col(c) + float(OFF_TIE), digits) - float(OFF_TIE)).alias(c)


def off_tie_sql(expr: str, digits: int, out: str) -> str:
    return f"round({expr} + {OFF_TIE}, {digits}) - {OFF_TIE} AS {out}"


_OHLCV = ["open", "high", "low", "close", "volume"]
_PARTS = ("1m", "5m", "15m", "1h", "1d", "1w", "1mo")


def _all_targets(t):
    """Ticks to every target: ticks are read once, each coarser target comes from the next finer one, weeks and months from days."""
    chain = resample.resample_chain(t.ticks(), list(_PARTS))
    frames = [chain[to].select(F.lit(to).alias("target"), "symbol", "datetime", *_OHLCV, r("turnover", 4)) for to in _PARTS]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _docs_week_month(t):
    week = resample.resample(t.bars(), "1w").withColumn("label", F.lit("week"))
    month = resample.resample(t.bars(), "1mo", month_end=True).withColumn("label", F.lit("month"))
    return week.unionByName(month).select("label", "symbol", "datetime", *_OHLCV)


QUERIES = {
    "resample_ohlcv": on_tables(_all_targets),
    "resample_turnover_default": on_tables(lambda t: resample.resample(t.bars().drop("turnover", "open_interest"), "1mo").select(
        "symbol", "datetime", "close", off_tie("turnover", 3), "open_interest")),
    "weekly_monthly_docs": on_tables(_docs_week_month),
    "count_by_symbol": on_tables(lambda t: t.bars().groupBy("symbol").agg(F.count("*").alias("n"))),
    "avg_close_by_symbol": on_tables(lambda t: t.bars().groupBy("symbol").agg(F.avg("close").alias("c")).select("symbol", r("c", 6, "avg_close"))),
    "pivot_close": on_tables(lambda t: profile.pivot_close(t.prices()).select("trade_date", "symbol", off_tie("close", 6))),
    "minute_stats": on_tables(lambda t: profile.minute_stats(t.ticks()).select(
        "symbol", "row_count", "first_time", "last_time", "last_close", "total_volume", "min_low", "max_high")),
    "series_count_range": on_tables(lambda t: profile.series_count_range(t.ticks(), ["symbol"])),
    "layer_summary": on_tables(lambda t: pipelines.layer_summary(t.bars(), t.adj_factor(), t.ods_financial(), t.fundamentals())),
    "frame_summary": on_tables(lambda t: profile.frame_summary(t.prices(), "price").select(
        "data_type", "total_records", "total_columns", "start", "end", "symbol_count", r("missing_ratio", 9), "duplicate_count")),
    "sentiment_summary": on_tables(lambda t: summaries.sentiment_summary(t.news()).select(
        "symbol", "total_count", "positive_count", "negative_count", "neutral_count", r("avg_sentiment_score", 11), r("avg_confidence", 11))),
    "flow_summary": on_tables(lambda t: summaries.flow_summary(t.flows()).select(
        "symbol", r("total_net_amount", 2), r("total_inflow", 2), r("total_outflow", 2), r("avg_turnover_rate", 11), "inflow_days", "outflow_days")),
    "report_summary": on_tables(lambda t: summaries.report_summary(t.reports()).select(
        "symbol", "total_count", "buy_count", "sell_count", "hold_count", off_tie("avg_target_price", 6), F.array_join("institutions", ",").alias("institutions"))),
    "theme_summary": on_tables(lambda t: summaries.theme_summary(t.themes()).select(
        "symbol", "total_count", "concept_count", "sector_count", "industry_count", r("avg_weight", 11),
        F.array_join(F.transform("top_themes", lambda x: x["theme_name"]), ",").alias("top_themes"))),
    "top_trader_summary": on_tables(lambda t: summaries.top_trader_summary(t.top_traders()).select(
        "symbol", "total_count", r("total_buy_amount", 2), r("total_sell_amount", 2), r("total_net_amount", 2), off_tie("avg_turnover_rate", 6),
        r("avg_price_change", 8))),
    "index_concentration": on_tables(lambda t: summaries.index_concentration(t.index_members()).select(
        "index_code", "total_components", *[r(c, 9) for c in _CONC])),
    "industry_hierarchy": on_tables(lambda t: summaries.industry_hierarchy(t.industry())),
    "industry_stats": on_tables(lambda t: summaries.industry_stats(t.industry())),
    "macro_trend": on_tables(lambda t: summaries.macro_trend(t.macro()).select(
        "data_code", "data_points", "first_value", "last_value", r("total_change", 5), "total_change_rate", r("average_value", 4), "ma12", "ma6",
        "volatility", "max_value", "min_value", "trend")),
    "macro_corr": on_tables(lambda t: summaries.macro_corr(t.macro(), CODES).select(
        "series1", "series2", "data_points", r("correlation", 6), "is_strong", "strength")),
    "profile_table": on_tables(lambda t: profile.profile_table(t.raw("orders")).select(
        "column", "kind", "nulls", "distinct", *[r(c, 5) for c in _STATS], "mode", "mode_count", "min_date", "max_date", "span_days")),
    # A sum of doubles depends on the order of its rows in the last bits; amounts are counted as they are to four decimals.
    "bar_profile": on_tables(lambda t: profile.table_totals(t.bars().drop("open_interest").withColumn("turnover", F.round("turnover", 4)))),
    "fin_profile": on_tables(lambda t: profile.table_totals(t.financials().select(
        "symbol", "exchange", "report_date", "report_type", F.round("revenue", 4).alias("revenue"), F.round("net_profit", 4).alias("net_profit"),
        F.round("total_assets", 2).alias("total_assets"), F.round("total_liabilities", 2).alias("total_liabilities")))),
}
_CONC = ["total_weight", "hhi", "max_weight", "min_weight", "avg_weight", "top10_weight", "top10_concentration"]
_STATS = ["mean", "std", "min", "q1", "median", "q3", "max"]


def _resampled(target: str, label: str, source: str = "ticks", turnover: bool = True, name: str = "target") -> str:
    extra = f", {rq('sum(turnover)', 4, 'turnover')}" if turnover else ""
    return (f"SELECT '{target}' AS {name}, symbol, CAST({label} AS TIMESTAMP) AS datetime, arg_min(open, datetime) AS open, max(high) AS high, "
            f"min(low) AS low, arg_max(close, datetime) AS close, sum(volume) AS volume{extra} FROM {source} GROUP BY 2, 3")


_LABEL = {
    "1m": "time_bucket(INTERVAL 1 MINUTE, datetime)", "5m": "time_bucket(INTERVAL 5 MINUTE, datetime)",
    "15m": "time_bucket(INTERVAL 15 MINUTE, datetime)", "1h": "date_trunc('hour', datetime)", "1d": "date_trunc('day', datetime)",
    "1w": "date_trunc('week', datetime) + INTERVAL 6 DAY", "1mo": "date_trunc('month', datetime)",
}


def _distinct_total(cols: list[str], table: str) -> str:
    return (f"SELECT count(*) AS row_count, {len(cols)} AS column_count, CAST("
            + " + ".join(f"count(*) - count({c})" for c in cols) + " AS BIGINT) AS null_count, CAST(count(*) - "
            f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(cols)} FROM {table})) AS BIGINT) AS duplicate_count, CAST("
            + " + ".join(f"count(DISTINCT {c})" for c in cols) + f" AS BIGINT) AS unique_count FROM {table}")


def _profile_sql() -> str:
    numeric, text = ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]
    none = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in _STATS)
    head = "SELECT '{c}' AS \"column\", '{k}' AS kind, CAST(count(*) - count({c}) AS BIGINT) AS nulls, count(DISTINCT {c}) AS \"distinct\", "
    parts = [
        head.format(c=c, k="numeric") + f"{rq(f'avg({c})', 5, 'mean')}, {rq(f'stddev_samp({c})', 5, 'std')}, {rq(f'CAST(min({c}) AS DOUBLE)', 5, 'min')}, "
        + ", ".join(rq(f"quantile_cont({c}, {q}e0)", 5, n) for q, n in (("0.25", "q1"), ("0.5", "median"), ("0.75", "q3")))
        + f", {rq(f'CAST(max({c}) AS DOUBLE)', 5, 'max')}, CAST(NULL AS VARCHAR) AS mode, CAST(NULL AS BIGINT) AS mode_count, CAST(NULL AS TIMESTAMP) "
        "AS min_date, CAST(NULL AS TIMESTAMP) AS max_date, CAST(NULL AS BIGINT) AS span_days FROM orders" for c in numeric
    ] + [
        head.format(c=c, k="text") + f"{none}, (SELECT {c} FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode, "
        f"(SELECT count(*) FROM orders GROUP BY {c} ORDER BY 1 DESC LIMIT 1) AS mode_count, NULL, NULL, NULL FROM orders" for c in text
    ] + [
        head.format(c="o_orderdate", k="time") + f"{none}, NULL, NULL, min(o_orderdate), max(o_orderdate), "
        "date_diff('day', min(o_orderdate), max(o_orderdate)) FROM orders"
    ]
    return " UNION ALL ".join(parts)


ORACLE = {
    "resample_ohlcv": sql(" UNION ALL ".join(_resampled(k, v) for k, v in _LABEL.items()), "ticks"),
    "resample_turnover_default": sql(
        "SELECT symbol, CAST(m AS TIMESTAMP) AS datetime, arg_max(close, datetime) AS close, "
        f"{off_tie_sql('sum(close * volume)', 3, 'turnover')}, 0e0 AS open_interest FROM (SELECT *, date_trunc('month', datetime) AS m FROM bars) "
        "GROUP BY symbol, m", "bars"),
    "weekly_monthly_docs": sql(
        _resampled("week", _LABEL["1w"], "bars", False, "label") + " UNION ALL " + _resampled("month", "last_day(datetime)", "bars", False, "label"), "bars"),
    "count_by_symbol": sql("SELECT symbol, count(*) AS n FROM bars GROUP BY 1", "bars"),
    "avg_close_by_symbol": sql(f"SELECT symbol, {rq('avg(close)', 6, 'avg_close')} FROM bars GROUP BY 1", "bars"),
    "pivot_close": sql(
        f"SELECT trade_date, symbol, {off_tie_sql('avg(close)', 6, 'close')} FROM prices GROUP BY 1, 2", "prices"),
    "minute_stats": sql(
        "SELECT symbol, count(*) AS row_count, min(datetime) AS first_time, max(datetime) AS last_time, arg_max(close, datetime) AS last_close, "
        "sum(volume) AS total_volume, min(low) AS min_low, max(high) AS max_high FROM ticks GROUP BY 1", "ticks"),
    "series_count_range": sql("SELECT symbol, count(*) AS n, min(datetime) AS first_time, max(datetime) AS last_time FROM ticks GROUP BY 1", "ticks"),
    "layer_summary": sql(
        "SELECT exchange, symbol, layer, count(*) AS n, CAST(min(d) AS DATE) AS first_date, CAST(max(d) AS DATE) AS last_date FROM ("
        + " UNION ALL ".join(f"SELECT exchange, symbol, '{k}' AS layer, datetime AS d FROM bars" for k in ("ods_bars", "dwd_bars", "dws_adjusted", "dws_factors"))
        + " UNION ALL " + " UNION ALL ".join(f"SELECT exchange, symbol, '{k}', CAST(NULL AS TIMESTAMP) FROM {t}" for k, t in
                                            (("ods_financial", "financials"), ("dws_merged", "financials"), ("ods_fundamental", "fundamentals")))
        + ") GROUP BY 1, 2, 3", "bars", "financials", "fundamentals"),
    "frame_summary": sql(
        "SELECT 'price' AS data_type, count(*) AS total_records, 9 AS total_columns, min(trade_date) AS start, max(trade_date) AS \"end\", "
        "count(DISTINCT symbol) AS symbol_count, 0e0 AS missing_ratio, 0 AS duplicate_count FROM prices", "prices"),
    "sentiment_summary": sql(
        "SELECT symbol, count(*) AS total_count, " + ", ".join(f"count(*) FILTER (sentiment = '{s}') AS {s}_count" for s in ("positive", "negative", "neutral"))
        + f", {rq('avg(sentiment_score)', 11, 'avg_sentiment_score')}, {rq('avg(confidence)', 11, 'avg_confidence')} FROM news WHERE confidence >= 0.5 GROUP BY 1", "news"),
    "flow_summary": sql(
        f"SELECT symbol, {rq('sum(net_amount)', 2, 'total_net_amount')}, {rq('sum(inflow_amount)', 2, 'total_inflow')}, {rq('sum(outflow_amount)', 2, 'total_outflow')}, "
        f"{rq('avg(turnover_rate)', 11, 'avg_turnover_rate')}, count(*) FILTER (direction = 'inflow') AS inflow_days, "
        "count(*) FILTER (direction = 'outflow') AS outflow_days FROM flows GROUP BY 1", "flows"),
    "report_summary": sql(
        "SELECT symbol, count(*) AS total_count, count(*) FILTER (rating IN ('buy', 'strong_buy')) AS buy_count, "
        "count(*) FILTER (rating IN ('sell', 'strong_sell')) AS sell_count, count(*) FILTER (rating = 'hold') AS hold_count, "
        f"{off_tie_sql('coalesce(avg(target_price), 0)', 6, 'avg_target_price')}, coalesce(array_to_string(list_sort(list(DISTINCT institution) "
        "FILTER (institution <> '')), ','), '') AS institutions FROM reports GROUP BY 1", "reports"),
    "theme_summary": sql(
        "SELECT symbol, count(*) AS total_count, " + ", ".join(f"count(*) FILTER (theme_type = '{k}') AS {k}_count" for k in ("concept", "sector", "industry"))
        + f", {rq('avg(weight)', 11, 'avg_weight')}, array_to_string(list(theme_name ORDER BY weight DESC, theme_name, theme_id)[1:5], ',') AS top_themes "
        "FROM themes GROUP BY 1", "themes"),
    "top_trader_summary": sql(
        f"SELECT symbol, count(*) AS total_count, {rq('sum(buy_amount)', 2, 'total_buy_amount')}, {rq('sum(sell_amount)', 2, 'total_sell_amount')}, "
        f"{rq('sum(net_amount)', 2, 'total_net_amount')}, {off_tie_sql('avg(turnover_rate)', 6, 'avg_turnover_rate')}, {rq('avg(price_change)', 8, 'avg_price_change')} "
        "FROM top_traders GROUP BY 1", "top_traders"),
    "index_concentration": sql(
        "SELECT index_code, count(*) AS total_components, " + ", ".join(rq(e, 9, n) for e, n in (
            ("sum(weight)", "total_weight"), ("sum(weight * weight)", "hhi"), ("max(weight)", "max_weight"), ("min(weight)", "min_weight"),
            ("avg(weight)", "avg_weight"), ("sum(weight) FILTER (rn <= 10)", "top10_weight"),
            ("sum(weight) FILTER (rn <= 10) / sum(weight)", "top10_concentration")))
        + " FROM (SELECT *, row_number() OVER (PARTITION BY index_code ORDER BY weight DESC, symbol) AS rn FROM index_members) GROUP BY 1", "index_members"),
    "industry_hierarchy": sql(
        "SELECT symbol, " + ", ".join(f"max(industry_name) FILTER (industry_level = 'level{i}') AS level{i}" for i in (1, 2, 3, 4))
        + " FROM industry GROUP BY 1", "industry"),
    "industry_stats": sql(
        "SELECT 'industry' AS kind, industry_code || '_' || industry_name AS name, count(*) AS n FROM industry GROUP BY 2 UNION ALL "
        "SELECT 'level', industry_level, count(*) FROM industry GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'most_common', "
        "industry_code || '_' || industry_name AS name, count(*) AS n FROM industry GROUP BY 2 ORDER BY n DESC, name DESC LIMIT 1)", "industry"),
    "macro_trend": sql(
        f"SELECT data_code, n AS data_points, f AS first_value, l AS last_value, {rq('l - f', 5, 'total_change')}, "
        f"round((l - f) / f * 100, 2) AS total_change_rate, {rq('a', 4, 'average_value')}, round(CASE WHEN n < 12 THEN a ELSE a12 END, 2) AS ma12, "
        "round(CASE WHEN n < 12 THEN a ELSE a6 END, 2) AS ma6, round(s, 2) AS volatility, hi AS max_value, lo AS min_value, "
        "CASE WHEN l > f THEN '@TREND_UP@' WHEN l < f THEN '@TREND_DOWN@' ELSE '@TREND_FLAT@' END AS trend FROM (SELECT data_code, count(*) AS n, arg_min(value, date) AS f, "
        "arg_max(value, date) AS l, avg(value) AS a, avg(value) FILTER (rn <= 12) AS a12, avg(value) FILTER (rn <= 6) AS a6, "
        "coalesce(stddev_samp(value), 0) AS s, max(value) AS hi, min(value) AS lo FROM (SELECT *, row_number() OVER (PARTITION BY data_code "
        "ORDER BY date DESC) AS rn FROM macro) GROUP BY 1)", "macro"),
    "macro_corr": sql(
        "WITH w AS (SELECT date FROM macro GROUP BY 1 HAVING count(*) = 5), c(code, i) AS (VALUES " + ", ".join(
            f"('{c}', {i})" for i, c in enumerate(CODES)) + ") SELECT series1, series2, data_points, " + rq("k", 6, "correlation")
        + ", abs(k) >= 0.7 AS is_strong, CASE WHEN abs(k) >= 0.7 THEN CASE WHEN k > 0 THEN '@CORR_POSITIVE@' ELSE '@CORR_NEGATIVE@' END END AS strength FROM ("
        "SELECT a.code AS series1, b.code AS series2, count(*) AS data_points, corr(x.value, y.value) AS k FROM c a JOIN c b ON a.i < b.i "
        "JOIN macro x ON x.data_code = a.code JOIN macro y ON y.data_code = b.code AND x.date = y.date WHERE x.date IN (SELECT date FROM w) GROUP BY 1, 2)",
        "macro"),
    "profile_table": _profile_sql(),
    "bar_profile": sql(_distinct_total(
        ["symbol", "exchange", '"interval"', "datetime", "open", "high", "low", "close", "volume", "turnover"], "b").replace(
        "FROM b", "FROM (SELECT * REPLACE (round(turnover, 4) AS turnover) FROM bars)"), "bars"),
    "fin_profile": sql(
        "WITH f AS (SELECT symbol, exchange, report_date, report_type, round(revenue, 4) AS revenue, round(net_profit, 4) AS net_profit, "
        "round(total_assets, 2) AS total_assets, round(total_liabilities, 2) AS total_liabilities FROM financials) " + _distinct_total(
            ["symbol", "exchange", "report_date", "report_type", "revenue", "net_profit", "total_assets", "total_liabilities"], "f"), "financials"),
}
