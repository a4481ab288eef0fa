"""Queries of the layer stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import layers
from tapeloom.plans import lake, pipelines
from tapeloom.registry.base_sql import define, sql
from tapeloom.registry.common import on_tables, r, rq
from tapeloom.session import scratch_path
from tapeloom.sinks import tables as sinks

KEY = ["exchange", "symbol", "datetime"]


def dirty(t):
    """Bars with faults on some days of the month: price order, signs, gaps, no trade."""
    d = F.dayofmonth("datetime")
    return t.bars().withColumns({
        "low": F.when(d == 3, F.col("high") + 1).otherwise(F.col("low")),
        "volume": F.when(d == 7, -F.col("volume")).when(d == 13, 0.0).otherwise(F.col("volume")),
        "turnover": F.when(d == 9, -F.col("turnover")).otherwise(F.col("turnover")),
        "close": F.when(d == 11, None).otherwise(F.col("close")),
    })


define("dirty", ["bars"], """
SELECT * REPLACE (CASE WHEN day(datetime) = 3 THEN high + 1 ELSE low END AS low,
  CASE day(datetime) WHEN 7 THEN -volume WHEN 13 THEN 0e0 ELSE volume END AS volume,
  CASE WHEN day(datetime) = 9 THEN -turnover ELSE turnover END AS turnover,
  CASE WHEN day(datetime) <> 11 THEN close END AS close) FROM bars""")
ISSUES = """concat_ws(';', CASE WHEN NOT coalesce(low <= open AND open <= high, false) THEN '@BAD_PRICE_ORDER@' END,
  CASE WHEN NOT coalesce(low <= close AND close <= high, false) THEN '@BAD_PRICE_ORDER@' END,
  CASE WHEN volume < 0 THEN '@BAD_VOLUME@' END{})"""
TURNOVER = ", CASE WHEN turnover < 0 THEN '@BAD_TURNOVER@' END"


def _fin_dirty(t):
    """Raw statements with a negative revenue, a zero profit or no assets in some quarters."""
    m, y = F.month("report_date"), F.year("report_date")
    inc, bal = F.col("raw_income"), F.col("raw_balance")
    revenue = F.when((m == 3) & (y == 1997), -inc["total_revenue"]).otherwise(inc["total_revenue"])
    profit = F.when((m == 6) & (y == 1997), 0.0).otherwise(inc["net_profit"])
    assets = F.when((m == 9) & (y == 1997), 0.0).otherwise(bal["total_assets"])
    return t.ods_financial().withColumns({
        "raw_income": F.create_map(F.lit("total_revenue"), revenue, F.lit("net_profit"), profit),
        "raw_balance": F.create_map(F.lit("total_assets"), assets, F.lit("shareholders_equity"), bal["shareholders_equity"]),
    })


def _fund_dirty(t):
    d, raw = F.dayofmonth("date"), F.col("raw_data")
    return t.ods_fundamental().withColumn("raw_data", F.create_map(
        F.lit("pe_ratio"), F.when(d == 5, -raw["pe_ratio"]).otherwise(raw["pe_ratio"]),
        F.lit("pb_ratio"), F.when(d == 6, -raw["pb_ratio"]).otherwise(raw["pb_ratio"]),
        F.lit("market_cap"), F.when(d == 7, 0.0).otherwise(raw["market_cap"]),
        F.lit("circulating_cap"), raw["circulating_cap"]))


def _ods(t):
    return layers.ods_bars(t.bars(), "lake")


def _texts(c: str = "quality_issues"):
    return F.array_join(c, ";").alias("issues")


def _layered(t, path, wanted=None):
    """The four layers of all bars, or of the ``wanted`` ones."""
    tasks = t.series_tasks()
    bars = t.bars(tasks)
    return lake.run_bar_layers(bars if wanted is None else bars.filter(wanted), "lake", path, t.adj_factor(), tasks=tasks)


def _refreshed(t):
    """Layers of all bars but those of spring 1997, then a refresh with these; the derived tables side by side."""
    path = scratch_path(t.spark, "refresh")
    spring = (F.year("datetime") == 1997) & F.month("datetime").between(3, 4)
    _layered(t, path, ~spring)
    lake.refresh_bar_layers(t.spark, path, t.bars().filter(spring), "lake", t.adj_factor())
    adjusted, factors = (sinks.read_table(t.spark, f"{path}/{name}") for name in ("dws_adjusted", "dws_factors"))
    return adjusted.join(factors.select("exchange", "symbol", "datetime", "volume_ratio", "price_momentum_5d", "price_momentum_20d"), ["exchange", "symbol", "datetime"])


_DWS = ["pe_ratio", "pb_ratio", "ps_ratio", "roe", "roa", "net_margin"]
QUERIES = {
    "ods_bars": on_tables(lambda t: _ods(t).select(*KEY, "close", "source", "quality_score")),
    "dwd_bars": on_tables(lambda t: layers.dwd_bars(layers.ods_bars(dirty(t), "lake")).select(*KEY, "amount", "vwap", "is_valid", _texts())),
    "dwd_bars_v2": on_tables(lambda t: layers.dwd_bars(layers.ods_bars(dirty(t), "lake"), variant=2).select(*KEY, "amount", "vwap", "is_valid", _texts())),
    "dwd_financial": on_tables(lambda t: layers.dwd_financial(_fin_dirty(t)).select(
        "symbol", "report_date", r("total_revenue", 4), r("net_profit", 4), "total_liabilities", r("roe", 6), r("roa", 6), "is_valid", _texts())),
    "dwd_fundamental": on_tables(lambda t: layers.dwd_fundamental(_fund_dirty(t)).select(
        "symbol", "date", "pe_ratio", "pb_ratio", "ps_ratio", "market_cap", "is_valid", _texts())),
    "dws_adjusted": on_tables(lambda t: layers.dws_adjusted(layers.dwd_bars(_ods(t)), t.adj_factor()).select(
        *KEY, "close_qfq", "close_hfq", "qfq_factor", r("hfq_factor", 9), "source_dwd")),
    "dws_flow_factors": on_tables(lambda t: layers.dws_flow_factors(layers.dwd_bars(_ods(t))).select(
        *KEY, "net_inflow", r("volume_ratio", 7), r("price_momentum_5d", 8), r("price_momentum_20d", 8))),
    "dws_merged_financial": on_tables(lambda t: layers.dws_merged(layers.dwd_financial(t.ods_financial()), t.fundamentals()).select(
        "symbol", "report_date", *[r(c, 5) for c in _DWS], r("revenue_growth_yoy", 5))),
    "bar_layers_pipeline": on_tables(lambda t: _layered(t, scratch_path(t.spark, "lake"))),
    "financial_layers_pipeline": on_tables(lambda t: lake.run_financial_layers(t.ods_financial(), t.fundamentals(), scratch_path(t.spark, "lake"))),
    "bar_layer_counts": on_tables(lambda t: pipelines.layer_counts(pipelines.bar_layers(t.bars(), "lake", t.adj_factor()))),
    "financial_layer_counts": on_tables(lambda t: pipelines.layer_counts(pipelines.financial_layers(t.ods_financial(), t.fundamentals()))),
    "bar_layers_refresh": on_tables(lambda t: _refreshed(t).select(
        "exchange", "symbol", "datetime", "close_qfq", r("volume_ratio", 7), r("price_momentum_5d", 8), r("price_momentum_20d", 8))),
    "batch_symbols": on_tables(lambda t: pipelines.batch_status(
        t.universe().select("symbol"), pipelines.bar_layers(t.bars(), "lake", t.adj_factor()))),
}

_COUNT = "SELECT exchange, symbol, '{}' AS layer, count(*) AS n FROM {} GROUP BY 1, 2"
_SPAN = "SELECT '{0}' AS layer, count(*) AS n, CAST(min({1}) AS DATE) AS first_date, CAST(max({1}) AS DATE) AS last_date FROM {2}"
_BARS4 = ("ods_bars", "dwd_bars", "dws_adjusted", "dws_factors")
ORACLE = {
    "ods_bars": sql("SELECT exchange, symbol, datetime, close, 'lake' AS source, 1e0 AS quality_score FROM bars", "bars"),
    "dwd_bars": sql(
        "SELECT exchange, symbol, datetime, volume * close AS amount, CASE WHEN volume = 0 THEN close ELSE (open + high + low + close) / 4 END AS vwap, "
        f"issues = '' AS is_valid, issues FROM (SELECT *, {ISSUES.format(TURNOVER)} AS issues FROM dirty)", "dirty"),
    "dwd_bars_v2": sql(
        "SELECT exchange, symbol, datetime, volume * close AS amount, (open + high + low + close) / 4 AS vwap, "
        f"issues = '' AS is_valid, issues FROM (SELECT *, {ISSUES.format('')} AS issues FROM dirty)", "dirty"),
    "dwd_financial": sql(
        f"SELECT symbol, report_date, {rq('rv', 4, 'total_revenue')}, {rq('np', 4, 'net_profit')}, 0e0 AS total_liabilities, "
        f"{rq('np / total_equity * 100', 6, 'roe')}, {rq('CASE WHEN ta > 0 THEN np / ta * 100 ELSE 0 END', 6, 'roa')}, issues = '' AS is_valid, issues FROM ("
        "SELECT *, concat_ws(';', CASE WHEN rv < 0 THEN '@NEGATIVE_REVENUE@' END, CASE WHEN np = 0 AND rv > 0 THEN '@ZERO_PROFIT@' END, "
        "CASE WHEN ta <= 0 THEN '@BAD_ASSETS@' END) AS issues FROM (SELECT *, CASE WHEN month(report_date) = 3 AND year(report_date) = 1997 THEN -revenue "
        "ELSE revenue END AS rv, CASE WHEN month(report_date) = 6 AND year(report_date) = 1997 THEN 0 ELSE net_profit END AS np, "
        "CASE WHEN month(report_date) = 9 AND year(report_date) = 1997 THEN 0 ELSE total_assets END AS ta FROM financials))", "financials"),
    "dwd_fundamental": sql(
        "SELECT symbol, date, pe_ratio, pb_ratio, 0e0 AS ps_ratio, market_cap, issues = '' AS is_valid, issues FROM (SELECT *, concat_ws(';', "
        "CASE WHEN pe_ratio < 0 THEN '@NEGATIVE_PE@' END, CASE WHEN pb_ratio < 0 THEN '@NEGATIVE_PB@' END, CASE WHEN market_cap <= 0 THEN '@BAD_CAP@' END, "
        "CASE WHEN cc > market_cap THEN '@FLOAT_OVER_CAP@' END) AS issues FROM (SELECT * REPLACE (CASE WHEN day(date) = 5 THEN -pe_ratio ELSE pe_ratio END "
        "AS pe_ratio, CASE WHEN day(date) = 6 THEN -pb_ratio ELSE pb_ratio END AS pb_ratio, CASE WHEN day(date) = 7 THEN 0 ELSE market_cap END AS market_cap), "
        "market_cap * 0.8e0 AS cc FROM fundamentals))", "fundamentals"),
    "dws_adjusted": sql(
        "SELECT exchange, symbol, datetime, close * coalesce(qfq, 1) AS close_qfq, close * coalesce(1 / qfq, 1) AS close_hfq"
        ", coalesce(qfq, 1) AS qfq_factor, " + rq("coalesce(1 / qfq, 1)", 9, "hfq_factor")
        + ", 'dwd_bars_' || symbol || '_' || exchange || '_1d' AS source_dwd FROM adjusted", "adjusted"),
    "dws_flow_factors": sql(
        f"SELECT exchange, symbol, datetime, ni AS net_inflow, {rq('vr', 7, 'volume_ratio')}, {rq('m5', 8, 'price_momentum_5d')}, "
        f"{rq('m20', 8, 'price_momentum_20d')} FROM flow_windows", "flow_windows"),
    "dws_merged_financial": sql(
        "SELECT f.symbol, report_date, " + ", ".join(rq(e, 5, n) for e, n in (
            ("market_cap / nullif(net_profit, 0)", "pe_ratio"), ("market_cap / total_equity", "pb_ratio"), ("market_cap / revenue", "ps_ratio"),
            ("roe", "roe"), ("roa", "roa"), ("100 * net_profit / revenue", "net_margin"), ("revenue_growth", "revenue_growth_yoy")))
        + " FROM dwd_fin f ASOF LEFT JOIN (SELECT symbol, date, market_cap FROM fundamentals) u ON f.symbol = u.symbol AND f.report_date >= u.date",
        "dwd_fin", "fundamentals"),
    "bar_layers_pipeline": sql(" UNION ALL ".join(_SPAN.format(n, "datetime", "bars") for n in _BARS4), "bars"),
    "financial_layers_pipeline": sql(
        " UNION ALL ".join(_SPAN.format(n, "report_date", "financials") for n in ("ods_financial", "dwd_financial", "dws_merged")), "financials"),
    "bar_layers_refresh": sql(
        f"SELECT exchange, symbol, datetime, close * coalesce(qfq, 1) AS close_qfq, {rq('vr', 7, 'volume_ratio')}, {rq('m5', 8, 'price_momentum_5d')}, "
        f"{rq('m20', 8, 'price_momentum_20d')} FROM adjusted JOIN flow_windows USING (exchange, symbol, datetime)", "adjusted", "flow_windows"),
    "bar_layer_counts": sql(" UNION ALL ".join(_COUNT.format(n, "bars") for n in _BARS4), "bars"),
    "financial_layer_counts": sql(
        " UNION ALL ".join(_COUNT.format(n, "financials") for n in ("ods_financial", "dwd_financial", "dws_merged")), "financials"),
    "batch_symbols": sql(
        "SELECT symbol, CASE WHEN n > 0 THEN 'success' ELSE 'no_data' END AS status, 4 * coalesce(n, 0) AS total_rows FROM universe LEFT JOIN "
        "(SELECT symbol, count(*) AS n FROM bars GROUP BY 1) USING (symbol)", "universe", "bars"),
}
