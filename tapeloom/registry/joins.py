"""Queries of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import joins, lineage, series
from tapeloom.registry.base_sql import sql
from tapeloom.registry.common import on_tables, r, rq
from tapeloom.session import materialize
from tapeloom.sinks import tables as sinks

CODES = ["GDP", "CPI", "PPI", "M2", "UNEMPLOYMENT"]


def _fin(t):
    """Newest fundamentals and universe fields per symbol."""
    newest = joins.asof_snapshot(t.fundamentals(), ["symbol"], "date", "1999-06-30", ["pe_ttm"])
    return newest.drop("date").join(t.universe().select("symbol", "industry", "free_float_mkt_cap"), "symbol")


def _asof(t):
    probe = t.financials().select("exchange", "symbol", "publish_date")
    return joins.asof_join(probe, t.fundamentals(), ["exchange", "symbol"], "publish_date", "date", ["pe_ratio", "market_cap"])


def _bucketed(t):
    """Prices and fundamentals as tables bucketed by symbol, joined and put through a window with no further shuffle."""
    prices = sinks.write_bucketed(t.prices().select("symbol", "trade_date", "close", "volume"), "prices", ["symbol"], ["trade_date"], 8)
    fund = t.fundamentals().select("symbol", F.col("date").alias("trade_date"), "pe_ttm")
    fund = sinks.write_bucketed(fund, "fundamentals", ["symbol"], ["trade_date"], 8)
    with sinks.without_reshuffle(t.spark):
        return materialize(series.returns(prices.join(fund, ["symbol", "trade_date"]), keys=("symbol",), order="trade_date"))


QUERIES = {
    "join_price_fund_bucketed": on_tables(lambda t: _bucketed(t).select("symbol", "trade_date", "close", "pe_ttm", r("ret", 8))),
    "join_price_fund": on_tables(lambda t: t.prices().join(
        t.fundamentals().select("symbol", F.col("date").alias("trade_date"), "pe_ttm", "market_cap"), ["symbol", "trade_date"]).select(
        "symbol", "trade_date", "close", "volume", "pe_ttm", "market_cap")),
    "join_factor_fund": on_tables(lambda t: _factor_fund(t)),
    "semi_universe": on_tables(lambda t: joins.tradable_only(t.prices(), t.universe()).select("symbol", "trade_date", "close")),
    "join_adjust": on_tables(lambda t: joins.adjust_ratio(t.bars(), t.adj_factor(), "qfq").select(
        F.lit("qfq").alias("side"), "symbol", "datetime", "close").union(
        joins.adjust_ratio(t.bars(), t.adj_factor(), "hfq").select(F.lit("hfq"), "symbol", "datetime", "close"))),
    "asof_fundamental": on_tables(lambda t: _asof(t).select("symbol", "publish_date", "known_date", "pe_ratio", "market_cap")),
    "index_members_asof": on_tables(lambda t: joins.valid_at(t.index_members(), "1996-03-31").select("index_code", "symbol", r("weight", 9))),
    "asof_industry": on_tables(lambda t: joins.valid_at(t.industry(), "1996-03-31").select("symbol", "industry_level", "industry_name")),
    "index_members_by_day": on_tables(lambda t: joins.valid_on(
        t.prices().select("trade_date").distinct(), t.index_members(), [], "trade_date").select("trade_date", "index_code", "symbol", r("weight", 9))),
    "asof_industry_by_day": on_tables(lambda t: joins.valid_on(
        t.prices().select("symbol", "trade_date", "close"), t.industry().filter("industry_level = 'level2'"), ["symbol"], "trade_date").select(
        "symbol", "trade_date", "close", "industry_code", "industry_name")),
    "asof_ticks": on_tables(lambda t: joins.asof_join(
        t.ticks().filter("symbol = 'purchase'").select("exchange", "datetime", "close"),
        t.ticks().filter("symbol = 'view'").select("exchange", "datetime", F.col("close").alias("seen")), ["exchange"], "datetime", "datetime", ["seen"],
        chunk="6 hours").select("datetime", "close", "known_datetime", "seen")),
    "align_series": on_tables(lambda t: joins.align_series(t.macro(), CODES).select("date", *CODES)),
    "lineage_dataset_join": on_tables(lambda t: lineage.affected_datasets(
        t.lineage_nodes(), lineage.closure(t.lineage_edges()))),
    "apply_adjust_asof": on_tables(lambda t: joins.apply_adjust(t.bars(), t.adj_factor(shift_days=1), mode="asof").select(
        "symbol", "datetime", "close", "adj_factor")),
}


def _factor_fund(t):


    keys = ("symbol",)
    prices = t.prices().filter(F.col("trade_date") <= "1999-06-30")
    factor = series.momentum_span(prices, 120, keys, "trade_date").join(series.volatility_last(prices, 20, keys, "trade_date"), "symbol")
    return factor.join(_fin(t), "symbol").na.drop("any").select(
        "symbol", r("momentum", 8), r("volatility", 7), "pe_ttm", "industry", "free_float_mkt_cap")


_DESC = """(SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS ret,
  row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM prices WHERE trade_date <= DATE '1999-06-30')"""

ORACLE = {
    "join_price_fund_bucketed": sql(
        f"SELECT p.symbol, trade_date, close, pe_ttm, {rq('close / lag(close) OVER (PARTITION BY p.symbol ORDER BY trade_date) - 1', 8, 'ret')} "
        "FROM prices p JOIN fundamentals f ON p.symbol = f.symbol AND trade_date = date", "prices", "fundamentals"),
    "join_price_fund": sql(
        "SELECT p.symbol, trade_date, close, volume, pe_ttm, market_cap FROM prices p JOIN fundamentals f ON p.symbol = f.symbol AND trade_date = date",
        "prices", "fundamentals"),
    "join_factor_fund": sql(
        f"SELECT m.symbol, {rq('momentum', 8, 'momentum')}, {rq('volatility', 7, 'volatility')}, pe_ttm, industry, free_float_mkt_cap "
        "FROM (SELECT symbol, max(close) FILTER (rn = 1) / max(close) FILTER (rn = 120) - 1 AS momentum, "
        f"stddev_samp(ret) FILTER (rn <= 20) AS volatility FROM {_DESC} GROUP BY 1) m JOIN (SELECT symbol, arg_max(pe_ttm, date) AS pe_ttm "
        "FROM fundamentals WHERE date <= DATE '1999-06-30' GROUP BY 1) f ON m.symbol = f.symbol JOIN universe u ON m.symbol = u.symbol "
        "WHERE momentum IS NOT NULL AND volatility IS NOT NULL", "prices", "fundamentals", "universe"),
    "semi_universe": sql("SELECT symbol, trade_date, close FROM prices WHERE symbol IN (SELECT symbol FROM universe WHERE is_tradable)", "prices", "universe"),
    "join_adjust": sql(
        "SELECT 'qfq' AS side, symbol, datetime, close * qfq AS close FROM adjusted UNION ALL SELECT 'hfq', symbol, datetime, close * hfq FROM adjusted",
        "adjusted"),
    "asof_fundamental": sql(
        "SELECT p.symbol, publish_date, f.date AS known_date, pe_ratio, market_cap FROM financials p ASOF LEFT JOIN fundamentals f "
        "ON p.symbol = f.symbol AND p.exchange = f.exchange AND p.publish_date >= f.date", "financials", "fundamentals"),
    "index_members_asof": sql(
        f"SELECT index_code, symbol, {rq('weight', 9, 'weight')} FROM index_members WHERE effective_date <= DATE '1996-03-31' "
        "AND (end_date IS NULL OR end_date > DATE '1996-03-31')", "index_members"),
    "asof_industry": sql(
        "SELECT symbol, industry_level, industry_name FROM industry WHERE effective_date <= DATE '1996-03-31' "
        "AND (end_date IS NULL OR end_date > DATE '1996-03-31')", "industry"),
    "index_members_by_day": sql(
        f"SELECT trade_date, index_code, symbol, {rq('weight', 9, 'weight')} FROM (SELECT DISTINCT trade_date FROM prices) JOIN index_members "
        "ON effective_date <= trade_date AND (end_date IS NULL OR end_date > trade_date)", "prices", "index_members"),
    "asof_industry_by_day": sql(
        "SELECT p.symbol, trade_date, close, industry_code, industry_name FROM prices p JOIN industry i ON p.symbol = i.symbol AND industry_level = 'level2' "
        "AND effective_date <= trade_date AND (end_date IS NULL OR end_date > trade_date)", "prices", "industry"),
    "asof_ticks": sql(
        "SELECT p.datetime, p.close, v.datetime AS known_datetime, v.close AS seen FROM (SELECT * FROM ticks WHERE symbol = 'purchase') p ASOF LEFT JOIN "
        "(SELECT * FROM ticks WHERE symbol = 'view') v ON p.exchange = v.exchange AND p.datetime >= v.datetime", "ticks"),
    "align_series": sql(
        "SELECT date, " + ", ".join(f"max(value) FILTER (data_code = '{c}') AS {c}" for c in CODES)
        + " FROM macro GROUP BY 1 HAVING count(*) = 5", "macro"),
    "lineage_dataset_join": sql(
        "SELECT root AS node_id, dataset_id FROM (SELECT DISTINCT c.root, n.dataset_id FROM "
        "(WITH RECURSIVE c(root, node) AS (SELECT source_id, target_id FROM e UNION SELECT c.root, e.target_id FROM c JOIN e ON c.node = e.source_id) "
        "SELECT * FROM c) c JOIN lineage_nodes n ON c.node = n.node_id)".replace(" e ", " lineage_edges e "),
        "lineage_edges", "lineage_nodes"),
    "apply_adjust_asof": sql(
        "SELECT b.symbol, b.datetime, close * adj_factor AS close, adj_factor FROM bars b ASOF LEFT JOIN "
        "(SELECT symbol, datetime + INTERVAL 1 DAY AS datetime, adj_factor FROM adj_factor) a ON b.symbol = a.symbol AND b.datetime >= a.datetime",
        "bars", "adj_factor"),
}
