"""Queries of the per-series window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.carry import in_blocks, last_known
from tapeloom.operators import joins, performance, series
from tapeloom.registry.base_sql import define, sql
from tapeloom.registry.common import on_tables, r, rq

KEY = ["exchange", "symbol", "datetime"]
W = "PARTITION BY exchange, symbol ORDER BY datetime"
NOW = "2024-02-01 00:00:00"

define("rets", ["bars"], f"SELECT *, close / lag(close) OVER ({W}) - 1 AS ret FROM bars")
define("bars_desc", ["rets"], """
SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY datetime DESC) AS rn FROM rets""")
define("averages", ["bars"], f"""
SELECT exchange, symbol, datetime, close,
  CASE WHEN count(*) OVER ({W} ROWS 9 PRECEDING) = 10 THEN avg(close) OVER ({W} ROWS 9 PRECEDING) END AS f,
  CASE WHEN count(*) OVER ({W} ROWS 29 PRECEDING) = 30 THEN avg(close) OVER ({W} ROWS 29 PRECEDING) END AS s,
  row_number() OVER ({W}) AS rn FROM bars""")
define("signs", ["averages"], """
SELECT *, CASE WHEN f - s > abs(s) * 3e0 / 10000 THEN 1 WHEN f - s < -abs(s) * 3e0 / 10000 THEN -1 ELSE 0 END AS sg
FROM averages""")


def _gappy(t):
    """Bars whose close is missing on every seventh day of the calendar."""
    return t.bars().withColumn("close", F.when(F.dayofmonth("datetime") % 7 != 0, F.col("close")))


def _pnl(t):
    return performance.signal_pnl(series.ma_cross(t.bars(), 10, 30, band_bp=3.0, delay=1))


def _tick_windows(t):
    """Windows over ticks, whose series have no bound, in blocks of rows."""
    def compute(rows, keys):
        return series.volatility_n(series.sma(rows, {"ma20": 20}, keys=keys), 20, keys=keys)

    return in_blocks(t.ticks(), list(series.KEYS), ["datetime"], 20, compute, block_rows=500)


def _tick_gaps_filled(t):
    """Ticks that lost every third close and volume, filled forward in time chunks."""
    lost = F.unix_micros(F.col("datetime").cast("timestamp"))
    holed = t.ticks().withColumns({c: F.when(lost % 3 != k, F.col(c)) for k, c in enumerate(("close", "open"))})
    return last_known(holed, list(series.KEYS), ["datetime"], ["close", "open"], "6 hours")


QUERIES = {
    "tick_windows": on_tables(lambda t: _tick_windows(t).select("symbol", "datetime", r("ma20", 6), r("volatility", 6))),
    "tick_forward_fill": on_tables(lambda t: _tick_gaps_filled(t).select("symbol", "datetime", "close", "open")),
    "returns": on_tables(lambda t: series.returns(t.bars()).select(*KEY, r("ret", 8))),
    "momentum_n": on_tables(lambda t: series.momentum_n(t.bars(), 120).select(*KEY, r("momentum", 8))),
    "momentum_cfg": on_tables(
        lambda t: series.momentum_cfg(t.bars(), 120).select("exchange", "symbol", r("momentum", 8))
    ),
    "momentum_span": on_tables(
        lambda t: series.momentum_span(t.bars(), 120).select("exchange", "symbol", r("momentum", 8))
    ),
    "volatility_n": on_tables(lambda t: series.volatility_n(t.bars(), 20).select(*KEY, r("volatility", 7))),
    "volatility_last": on_tables(
        lambda t: series.volatility_last(t.bars(), 20).select("exchange", "symbol", r("volatility", 7))
    ),
    "valuation_inverse": on_tables(
        lambda t: series.valuation_inverse(t.fundamentals()).select("symbol", "date", r("valuation", 9))
    ),
    "annualized_vol": on_tables(
        lambda t: series.annualized_vol(t.bars()).select("exchange", "symbol", r("annualized_vol", 6))
    ),
    "sma": on_tables(lambda t: series.sma(t.bars(), {"ma5": 5, "ma20": 20}).select(*KEY, r("ma5", 6), r("ma20", 6))),
    "ema": on_tables(lambda t: series.ema(t.bars(), {"ema10": 10}).select(*KEY, r("ema10", 5))),
    "ma_cross_regime": on_tables(lambda t: series.ma_cross(t.bars(), 10, 30, band_bp=3.0).select(*KEY, "signal")),
    "ma_cross_pulse": on_tables(
        lambda t: series.ma_cross(t.bars(), 10, 30, mode="on_cross", band_bp=3.0).select(*KEY, "signal")
    ),
    "signal_postprocess": on_tables(
        lambda t: series.ma_cross(t.bars(), 10, 30, band_bp=3.0, long_only=True, delay=1).select(*KEY, "signal")
    ),
    "net_inflow": on_tables(
        lambda t: series.flow_factors(t.bars()).select(
            *KEY, "net_inflow", "main_inflow", "retail_inflow"
        )
    ),
    "volume_ratio": on_tables(lambda t: series.flow_factors(t.bars()).select(*KEY, r("volume_ratio", 7))),
    "price_momentum_5_20": on_tables(
        lambda t: series.flow_factors(t.bars()).select(
            *KEY, r("price_momentum_5d", 8), r("price_momentum_20d", 8), r("price_volume_ratio", 7)
        )
    ),
    "forward_fill": on_tables(lambda t: series.forward_fill(_gappy(t), ["close"]).select(*KEY, "close")),
    "apply_adjust": on_tables(
        lambda t: joins.apply_adjust(t.bars(), t.adj_factor()).select(*KEY, *joins.PRICES)
    ),
    "statement_growth": on_tables(
        lambda t: series.statement_growth(t.financials(), ["revenue", "total_assets"]).select(
            "symbol", "report_date", r("revenue_growth", 5), r("total_assets_growth", 6)
        )
    ),
    "valuation_percentile": on_tables(
        lambda t: series.valuation_percentile(t.fundamentals()).select("symbol", "date", r("pe_ratio_percentile", 6))
    ),
    "pct_rank_history": on_tables(
        lambda t: series.pct_rank_history(t.fundamentals()).select("symbol", "date", r("percentile", 6), "level")
    ),
    "latest_per_key": on_tables(
        lambda t: series.latest_per_key(t.bars(), list(series.KEYS), "datetime").drop("turnover", "interval")
    ),
    "last_n_reports": on_tables(
        lambda t: series.annual_reports(t.financials(), 3).select("symbol", "report_date", "report_period", r("revenue", 4))
    ),
    "data_age": on_tables(lambda t: series.data_age(t.ticks(), NOW).select(
        "symbol", "last_time", "age_seconds", "is_open", "needs_refresh")),
    "tail_per_symbol": on_tables(lambda t: series.tail_per_symbol(t.bars(), 120).select(*KEY, "close")),
    "signal_pnl": on_tables(lambda t: _pnl(t).select(*KEY, "position", r("pnl", 4))),
    "performance_summary": on_tables(
        lambda t: performance.performance_summary(_pnl(t)).select(
            "exchange", "symbol", "n_rows", r("total_pnl", 2), r("max_drawdown", 2), r("mean_pnl", 3), r("std_pnl", 3)
        )
    ),
}


def _cross(signal: str) -> str:
    return sql(
        f"SELECT exchange, symbol, datetime, CAST(CASE WHEN rn <= 30 THEN 0 ELSE {signal} END AS INTEGER) AS signal "
        f"FROM (SELECT *, coalesce(last_value(nullif(sg, 0) IGNORE NULLS) OVER ({W}), 0) AS regime, "
        f"coalesce(lag(sg) OVER ({W}), 0) AS prev FROM signs)", "signs",
    )


_PNL = f"""
SELECT exchange, symbol, datetime, position,
  coalesce(lag(position) OVER ({W}), 0) * (close - coalesce(lag(close) OVER ({W}), close))
    - 0.0012e0 * abs(position - coalesce(lag(position) OVER ({W}), 0)) * close AS pnl
FROM (SELECT exchange, symbol, datetime, close, 1000 * CASE WHEN rn <= 30 THEN 0 ELSE
        coalesce(lag(regime) OVER ({W}), 0) END AS position
      FROM (SELECT *, coalesce(last_value(nullif(sg, 0) IGNORE NULLS) OVER ({W}), 0) AS regime FROM signs))"""
define("pnl_rows", ["signs"], _PNL)

ORACLE = {
    "tick_windows": sql(
        f"SELECT symbol, datetime, {rq('CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END', 6, 'ma20')}, "
        f"{rq('CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END', 6, 'volatility')} FROM (SELECT *, close / lag(close) OVER "
        "(PARTITION BY symbol ORDER BY datetime) - 1 AS ret FROM ticks) WINDOW w AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
        "ticks"),
    "tick_forward_fill": sql(
        "SELECT symbol, datetime, last_value(c IGNORE NULLS) OVER w AS close, last_value(o IGNORE NULLS) OVER w AS open FROM (SELECT symbol, datetime, "
        "CASE WHEN epoch_us(datetime) % 3 <> 0 THEN close END AS c, CASE WHEN epoch_us(datetime) % 3 <> 1 THEN open END AS o FROM ticks) "
        "WINDOW w AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "ticks"),
    "returns": sql(f"SELECT exchange, symbol, datetime, {rq('ret', 8, 'ret')} FROM rets", "rets"),
    "momentum_n": sql(
        f"SELECT exchange, symbol, datetime, {rq(f'close / lag(close, 120) OVER ({W}) - 1', 8, 'momentum')} FROM bars",
        "bars",
    ),
    "momentum_cfg": sql(
        "SELECT exchange, symbol, " + rq("max(close) FILTER (rn = 1) / max(close) FILTER (rn = 121) - 1", 8, "momentum")
        + " FROM bars_desc GROUP BY 1, 2 HAVING max(rn) >= 121", "bars_desc",
    ),
    "momentum_span": sql(
        "SELECT exchange, symbol, " + rq("max(close) FILTER (rn = 1) / max(close) FILTER (rn = 120) - 1", 8, "momentum")
        + " FROM bars_desc GROUP BY 1, 2", "bars_desc",
    ),
    "volatility_n": sql(
        "SELECT exchange, symbol, datetime, " + rq(
            f"CASE WHEN count(ret) OVER ({W} ROWS 19 PRECEDING) = 20 THEN stddev_samp(ret) OVER ({W} ROWS 19 PRECEDING) END",
            7, "volatility") + " FROM rets", "rets",
    ),
    "volatility_last": sql(
        f"SELECT exchange, symbol, {rq('stddev_samp(ret)', 7, 'volatility')} FROM bars_desc WHERE rn <= 20 GROUP BY 1, 2",
        "bars_desc",
    ),
    "valuation_inverse": sql(
        f"SELECT symbol, date, {rq('1 / (pe_ttm + 1e-8)', 9, 'valuation')} FROM fundamentals", "fundamentals"
    ),
    "annualized_vol": sql(
        f"SELECT exchange, symbol, {rq('stddev_samp(ret) * sqrt(252)', 6, 'annualized_vol')} FROM rets GROUP BY 1, 2",
        "rets",
    ),
    "sma": sql(
        "SELECT exchange, symbol, datetime, " + ", ".join(
            rq(f"CASE WHEN count(*) OVER ({W} ROWS {n - 1} PRECEDING) = {n} THEN avg(close) OVER "
               f"({W} ROWS {n - 1} PRECEDING) END", 6, f"ma{n}") for n in (5, 20)
        ) + " FROM bars", "bars",
    ),
    "ema": sql(
        "WITH n AS (SELECT exchange, symbol, datetime, close, row_number() OVER (" + W + ") AS rn FROM bars), "
        "e AS (SELECT exchange, symbol, rn, close AS ema FROM n WHERE rn = 1 UNION ALL "
        "SELECT n.exchange, n.symbol, n.rn, e.ema * (1 - 2e0 / 11) + n.close * (2e0 / 11) FROM e JOIN n "
        "ON n.exchange = e.exchange AND n.symbol = e.symbol AND n.rn = e.rn + 1) "
        "SELECT n.exchange, n.symbol, n.datetime, " + rq("CASE WHEN rn >= 10 THEN ema END", 5, "ema10")
        + " FROM e JOIN n USING (exchange, symbol, rn)", "bars", recursive=True,
    ),
    "ma_cross_regime": _cross("regime"),
    "ma_cross_pulse": _cross("CASE WHEN prev <= 0 AND sg > 0 THEN 1 WHEN prev >= 0 AND sg < 0 THEN -1 ELSE 0 END"),
    "signal_postprocess": sql(
        f"SELECT exchange, symbol, datetime, CAST(CASE WHEN rn <= 30 THEN 0 ELSE coalesce(lag(greatest(regime, 0)) "
        f"OVER ({W}), 0) END AS INTEGER) AS signal FROM (SELECT *, coalesce(last_value(nullif(sg, 0) IGNORE NULLS) "
        f"OVER ({W}), 0) AS regime FROM signs)", "signs",
    ),
    "net_inflow": sql(
        f"SELECT exchange, symbol, datetime, ni AS net_inflow, ni * 0.7e0 AS main_inflow, "
        "ni * 0.3e0 AS retail_inflow FROM flow_windows", "flow_windows",
    ),
    "volume_ratio": sql(
        f"SELECT exchange, symbol, datetime, {rq('vr', 7, 'volume_ratio')} FROM flow_windows", "flow_windows"
    ),
    "price_momentum_5_20": sql(
        f"SELECT exchange, symbol, datetime, {rq('m5', 8, 'price_momentum_5d')}, {rq('m20', 8, 'price_momentum_20d')}, "
        f"{rq('vr * m5', 7, 'price_volume_ratio')} FROM flow_windows", "flow_windows",
    ),
    "forward_fill": sql(
        f"SELECT exchange, symbol, datetime, last_value(CASE WHEN day(datetime) % 7 <> 0 THEN close END IGNORE NULLS) "
        f"OVER ({W}) AS close FROM bars", "bars",
    ),
    "apply_adjust": sql(
        "SELECT exchange, symbol, datetime, " + ", ".join(f"{c} * f AS {c}" for c in ("open", "high", "low", "close"))
        + f" FROM (SELECT b.*, last_value(adj_factor IGNORE NULLS) OVER (PARTITION BY exchange, symbol ORDER BY datetime) "
        "AS f FROM bars b LEFT JOIN adj_factor a USING (exchange, symbol, datetime))", "bars", "adj_factor",
    ),
    "statement_growth": sql(
        "SELECT symbol, report_date, " + ", ".join(
            rq(f"100 * ({c} / lag({c}) OVER (PARTITION BY exchange, symbol, report_type ORDER BY report_date) - 1)", d,
               f"{c}_growth") for c, d in (("revenue", 5), ("total_assets", 6))
        ) + " FROM financials", "financials",
    ),
    "valuation_percentile": sql(
        "SELECT symbol, date, " + rq(
            "len(list_filter(xs, lambda x: x >= pe_ratio)) * 100e0 / len(xs)", 6, "pe_ratio_percentile")
        + " FROM (SELECT symbol, date, pe_ratio, list(pe_ratio) OVER (PARTITION BY exchange, symbol ORDER BY date "
        "ROWS 251 PRECEDING) AS xs FROM fundamentals)", "fundamentals",
    ),
    "pct_rank_history": sql(
        "SELECT symbol, date, " + rq("p", 6, "percentile") + ", CASE WHEN p < 30 THEN 'cheap' WHEN p > 70 THEN 'dear' "
        "ELSE 'fair' END AS level FROM (SELECT symbol, date, (rank() OVER (PARTITION BY exchange, symbol ORDER BY "
        "pe_ratio) + (count(*) OVER (PARTITION BY exchange, symbol, pe_ratio) - 1) / 2e0) * 100 / count(*) OVER "
        "(PARTITION BY exchange, symbol) AS p FROM fundamentals)", "fundamentals",
    ),
    "latest_per_key": sql(
        "SELECT exchange, symbol, datetime, open, high, low, close, volume, open_interest FROM bars_desc WHERE rn = 1",
        "bars_desc",
    ),
    "last_n_reports": sql(
        "SELECT symbol, report_date, report_period, " + rq("revenue", 4, "revenue") + " FROM (SELECT *, row_number() "
        "OVER (PARTITION BY exchange, symbol ORDER BY report_date DESC) AS rn FROM financials "
        "WHERE report_period IN ('annual', 'q4')) WHERE rn <= 3", "financials",
    ),
    "data_age": sql(
        f"SELECT symbol, last_time, age AS age_seconds, age < 300 AS is_open, age >= 60 AS needs_refresh FROM ("
        f"SELECT symbol, max(datetime) AS last_time, CAST(epoch(TIMESTAMP '{NOW}') - floor(epoch(max(datetime))) "
        "AS BIGINT) AS age FROM ticks GROUP BY 1)", "ticks",
    ),
    "tail_per_symbol": sql("SELECT exchange, symbol, datetime, close FROM bars_desc WHERE rn <= 120", "bars_desc"),
    "signal_pnl": sql(
        f"SELECT exchange, symbol, datetime, position, {rq('pnl', 4, 'pnl')} FROM pnl_rows", "pnl_rows"
    ),
    "performance_summary": sql(
        f"SELECT exchange, symbol, count(*) AS n_rows, {rq('sum(pnl)', 2, 'total_pnl')}, "
        f"{rq('min(dd)', 2, 'max_drawdown')}, {rq('avg(pnl)', 3, 'mean_pnl')}, {rq('stddev_samp(pnl)', 3, 'std_pnl')} "
        f"FROM (SELECT *, c - max(c) OVER ({W}) AS dd FROM (SELECT *, sum(pnl) OVER ({W}) AS c FROM pnl_rows)) "
        "GROUP BY 1, 2", "pnl_rows",
    ),
}
