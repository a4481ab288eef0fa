"""Queries of the scan operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import layers
from tapeloom.registry.base_sql import sql
from tapeloom.registry.common import on_tables, r, rq
from tapeloom.sinks import tables as sinks
from tapeloom.sources import scans

S, E = "1996-01-01", "1999-06-30"
_RANGE = f"datetime BETWEEN TIMESTAMP '{S}' AND TIMESTAMP '{E}'"
_OHLC = ["open", "high", "low", "close"]
_BAR = ["exchange", "symbol", "datetime", *_OHLC, "volume"]


def _items(t):
    """An (exchange, symbol, interval) table: the tradable part of the universe."""
    key = F.col("symbol").cast("bigint")
    return t.universe().filter("is_tradable").select(
        F.when(key % 2 == 0, "SSE").otherwise("SZSE").alias("exchange"), "symbol", F.lit("1d").alias("interval")
    )


def _csv(t):
    path = sinks.scratch_path(t.spark, "bars-csv")
    sinks.export_csv(t.bars(), path)
    return scans.read_csv_bars(t.spark, path)


def _symbols(t):
    path = sinks.scratch_path(t.spark, "symbols")
    text = t.raw("supplier").select(F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("# "), "s_name")).otherwise(F.col("s_name")))
    text.write.text(path)
    return scans.read_symbol_list(t.spark, path)


def _stored(t, name: str, df, time: str = "datetime", monthly: bool = True):
    """A layer written as a partitioned table, then its range read back from the folders of that range."""
    path = sinks.scratch_path(t.spark, name)
    if monthly:
        sinks.write_bars(df, path)
    else:
        sinks.write_statements(df, path, time)
    return scans.scan_layer(sinks.read_table(t.spark, path), S, E, time, monthly)


def _dwd(t):
    return layers.dwd_bars(layers.ods_bars(t.bars(), "lake"))


QUERIES = {
    "scan_bars": on_tables(lambda t: scans.scan_range(t.bars(), start=S, end=E, columns=_BAR, order=["symbol", "datetime"])),
    "scan_minutes": on_tables(lambda t: scans.scan_range(
        t.ticks(), start="2024-01-05", end="2024-01-20", columns=["symbol", "datetime", "close", "volume", "turnover"],
        order=["symbol", "datetime"])),
    "scan_multi": on_tables(lambda t: scans.scan_multi(t.bars(), _items(t), S, E).drop("interval")),
    "scan_ods_bars": on_tables(lambda t: _stored(t, "ods", layers.ods_bars(t.bars(), "lake")).select(
        "exchange", "symbol", "datetime", "close", "year", "month")),
    "scan_ods_financial": on_tables(lambda t: _stored(
        t, "ods_financial", t.ods_financial(), "report_date", False).filter("report_type = 'income'").select(
        "symbol", "report_date", F.round(F.col("raw_income")["total_revenue"], 4).alias("total_revenue"), "source")),
    "scan_ods_fundamental": on_tables(lambda t: _stored(t, "ods_fundamental", t.ods_fundamental(), "date", False).select(
        "symbol", "date", F.col("raw_data")["pe_ratio"].alias("pe_ratio"), "quality_score")),
    "scan_dwd": on_tables(lambda t: _stored(t, "dwd", _dwd(t)).select(
        "exchange", "symbol", "datetime", "amount", "vwap", "is_valid")),
    "scan_dwd_financial": on_tables(lambda t: _stored(t, "dwd_financial", layers.dwd_financial(t.ods_financial()), "report_date", False).select(
        "symbol", "report_date", "report_type", r("total_revenue", 4), r("roe", 6), r("roa", 6), "is_valid")),
    "scan_dwd_fundamental": on_tables(lambda t: _stored(t, "dwd_fundamental", layers.dwd_fundamental(t.ods_fundamental()), "date", False).select(
        "symbol", "date", "pe_ratio", "market_cap", "is_valid")),
    "scan_dws_adjusted": on_tables(lambda t: _stored(t, "dws_adjusted", layers.dws_adjusted(_dwd(t), t.adj_factor())).select(
        "exchange", "symbol", "datetime", *[f"{c}_qfq" for c in _OHLC])),
    "scan_dws_factors": on_tables(lambda t: _stored(
        t, "dws_factors", layers.dws_flow_factors(t.bars()).withColumn("interval", F.lit("1d"))).select(
        "exchange", "symbol", "datetime", "net_inflow", r("volume_ratio", 7))),
    "scan_dws_merged": on_tables(lambda t: _stored(
        t, "dws_merged", layers.dws_merged(layers.dwd_financial(t.ods_financial()), t.fundamentals()), "report_date", False).select(
        "symbol", "report_date", r("roe", 6), r("roa", 6), r("revenue_growth_yoy", 5))),
    "scan_announcements": on_tables(lambda t: scans.scan_events(
        t.announcements(), "announcement_date", "2024-03-01", "2024-10-31").select(
        "doc_id", "symbol", "title", "content", "announcement_date", "announcement_type", "importance")),
    "scan_news": on_tables(lambda t: scans.scan_events(t.news(), "publish_date", "2024-03-01", "2024-10-31").select(
        "doc_id", "symbol", "title", "content", "publish_date", "sentiment", "sentiment_score", r("confidence", 6))),
    "scan_reports": on_tables(lambda t: scans.scan_events(t.reports(), "publish_date", S, E, "report_id").select(
        "report_id", "symbol", "title", "publish_date", "report_type", "rating", "target_price", "analyst", "institution")),
    "scan_flows": on_tables(lambda t: scans.scan_events(t.flows(), "date", S, E, "flow_id").select(
        "flow_id", "symbol", "date", "flow_type", "direction", "net_amount", "turnover_rate")),
    "scan_themes": on_tables(lambda t: t.themes().orderBy("symbol", F.col("weight").desc(), "theme_id")),
    "scan_top_traders": on_tables(lambda t: scans.scan_events(t.top_traders(), "date", S, E, "dragon_tiger_type").select(
        "symbol", "date", r("buy_amount", 2), r("sell_amount", 2), F.array_join("buy_seats", ",").alias("buy_seats"),
        F.array_join("sell_seats", ",").alias("sell_seats"), "turnover_rate")),
    "scan_index_members": on_tables(lambda t: t.index_members().filter(F.col("effective_date") >= "1995-02-01").orderBy(
        "index_code", F.col("weight").desc(), "symbol").select("index_code", "symbol", r("weight", 9), "effective_date")),
    "scan_industry": on_tables(lambda t: t.industry().filter("industry_standard = 'sw'").orderBy("symbol", "industry_level").select(
        "symbol", "industry_level", "industry_code", "industry_name", "parent_industry_name")),
    "scan_macro": on_tables(lambda t: scans.scan_range(t.macro(), "date", S, E, order=["data_code", "date"]).select(
        "data_code", "data_type", "date", "value", r("change_rate", 6))),
    "price_window": on_tables(lambda t: scans.price_window(
        t.prices(), t.universe().filter("is_tradable"), E, -130).select("symbol", "trade_date", "close", "volume")),
    "fundamental_asof": on_tables(lambda t: scans.fundamental_asof(
        t.financials(), E, ["report_date", "revenue", "net_profit"]).select(
        "symbol", "publish_date", "report_date", r("revenue", 4), r("net_profit", 4))),
    "universe_asof": on_tables(lambda t: scans.universe_asof(t.universe(), "1995-03-01").select(
        "universe", "symbol", "industry", "is_tradable", "is_st", "is_suspended")),
    "recent_minutes": on_tables(lambda t: scans.recent_rows(t.ticks(), 60).select(F.lit("last_n").alias("part"), "symbol", "datetime", "close").union(
        scans.rows_of_day(t.ticks(), "2024-01-30").select(F.lit("today"), "symbol", "datetime", "close")).union(
        scans.rows_since(t.ticks(), "2024-01-30 23:58:00").select(F.lit("realtime"), "symbol", "datetime", "close"))),
    "read_csv_bars": on_tables(lambda t: _csv(t).select(*_BAR)),
    "read_symbol_list": on_tables(_symbols),
}

_EVENT = "BETWEEN TIMESTAMP '2024-03-01' AND TIMESTAMP '2024-10-31'"
ORACLE = {
    "scan_bars": sql(f"SELECT {', '.join(_BAR)} FROM bars WHERE {_RANGE}", "bars"),
    "scan_minutes": sql(
        "SELECT symbol, datetime, close, volume, turnover FROM ticks WHERE datetime BETWEEN TIMESTAMP '2024-01-05' "
        "AND TIMESTAMP '2024-01-20'", "ticks"),
    "scan_multi": sql(
        f"SELECT {', '.join(_BAR)} FROM bars WHERE {_RANGE} AND symbol IN (SELECT symbol FROM universe WHERE is_tradable)",
        "bars", "universe"),
    "scan_ods_bars": sql(
        f"SELECT exchange, symbol, datetime, close, CAST(year(datetime) AS INTEGER) AS year, CAST(month(datetime) AS INTEGER) "
        f"AS month FROM bars WHERE {_RANGE}", "bars"),
    "scan_ods_financial": sql(
        f"SELECT symbol, report_date, round(revenue, 4) AS total_revenue, 'lake' AS source FROM financials "
        f"WHERE report_date BETWEEN DATE '{S}' AND DATE '{E}'", "financials"),
    "scan_ods_fundamental": sql(
        f"SELECT symbol, date, pe_ratio, 1e0 AS quality_score FROM fundamentals WHERE date BETWEEN DATE '{S}' AND DATE '{E}'",
        "fundamentals"),
    "scan_dwd": sql(
        f"SELECT exchange, symbol, datetime, volume * close AS amount, (open + high + low + close) / 4 AS vwap, "
        f"true AS is_valid FROM bars WHERE {_RANGE}", "bars"),
    "scan_dwd_financial": sql(
        f"SELECT symbol, report_date, report_type, {rq('revenue', 4, 'total_revenue')}, {rq('roe', 6, 'roe')}, {rq('roa', 6, 'roa')}, true AS is_valid "
        f"FROM dwd_fin WHERE report_date BETWEEN DATE '{S}' AND DATE '{E}'", "dwd_fin"),
    "scan_dwd_fundamental": sql(
        f"SELECT symbol, date, pe_ratio, market_cap, true AS is_valid FROM fundamentals WHERE date BETWEEN DATE '{S}' AND DATE '{E}'", "fundamentals"),
    "scan_dws_adjusted": sql(
        "SELECT exchange, symbol, datetime, " + ", ".join(f"{c} * coalesce(qfq, 1) AS {c}_qfq" for c in _OHLC)
        + f" FROM adjusted WHERE {_RANGE}", "adjusted"),
    "scan_dws_factors": sql(
        f"SELECT exchange, symbol, datetime, ni AS net_inflow, {rq('vr', 7, 'volume_ratio')} FROM flow_windows WHERE {_RANGE}",
        "flow_windows"),
    "scan_dws_merged": sql(
        f"SELECT symbol, report_date, {rq('roe', 6, 'roe')}, {rq('roa', 6, 'roa')}, {rq('revenue_growth', 5, 'revenue_growth_yoy')} "
        f"FROM dwd_fin WHERE report_date BETWEEN DATE '{S}' AND DATE '{E}'", "dwd_fin"),
    "scan_announcements": sql(
        "SELECT doc_id, symbol, title, content, announcement_date, announcement_type, importance FROM announcements "
        f"WHERE announcement_date {_EVENT}", "announcements"),
    "scan_news": sql(
        "SELECT doc_id, symbol, title, content, publish_date, sentiment, sentiment_score, " + rq("confidence", 6, "confidence")
        + f" FROM news WHERE publish_date {_EVENT}", "news"),
    "scan_reports": sql(
        "SELECT report_id, symbol, title, publish_date, report_type, rating, target_price, analyst, institution FROM reports "
        f"WHERE publish_date BETWEEN TIMESTAMP '{S}' AND TIMESTAMP '{E}'", "reports"),
    "scan_flows": sql(
        "SELECT flow_id, symbol, date, flow_type, direction, net_amount, turnover_rate FROM flows "
        f"WHERE date BETWEEN TIMESTAMP '{S}' AND TIMESTAMP '{E}'", "flows"),
    "scan_themes": sql("SELECT * FROM themes", "themes"),
    "scan_top_traders": sql(
        f"SELECT symbol, date, {rq('buy_amount', 2, 'buy_amount')}, {rq('sell_amount', 2, 'sell_amount')}, "
        "array_to_string(buy_seats, ',') AS buy_seats, array_to_string(sell_seats, ',') AS sell_seats, turnover_rate "
        f"FROM top_traders WHERE date BETWEEN TIMESTAMP '{S}' AND TIMESTAMP '{E}'", "top_traders"),
    "scan_index_members": sql(
        f"SELECT index_code, symbol, {rq('weight', 9, 'weight')}, effective_date FROM index_members "
        "WHERE effective_date >= DATE '1995-02-01'", "index_members"),
    "scan_industry": sql(
        "SELECT symbol, industry_level, industry_code, industry_name, parent_industry_name FROM industry", "industry"),
    "scan_macro": sql(
        f"SELECT data_code, data_type, date, value, {rq('change_rate', 6, 'change_rate')} FROM macro "
        f"WHERE date BETWEEN DATE '{S}' AND DATE '{E}'", "macro"),
    "price_window": sql(
        f"SELECT symbol, trade_date, close, volume FROM prices WHERE symbol IN (SELECT symbol FROM universe WHERE is_tradable) "
        f"AND trade_date BETWEEN DATE '{E}' - 130 AND DATE '{E}'", "prices", "universe"),
    "fundamental_asof": sql(
        f"SELECT symbol, publish_date, report_date, {rq('revenue', 4, 'revenue')}, {rq('net_profit', 4, 'net_profit')} FROM ("
        "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY publish_date DESC, report_date DESC) AS rn "
        f"FROM financials WHERE publish_date <= DATE '{E}') WHERE rn = 1", "financials"),
    "universe_asof": sql(
        "SELECT universe, symbol, industry, is_tradable, is_st, is_suspended FROM universe "
        "WHERE effective_date <= DATE '1995-03-01'", "universe"),
    "recent_minutes": sql(
        "SELECT 'last_n' AS part, symbol, datetime, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "
        "datetime DESC) AS rn FROM ticks) WHERE rn <= 60 UNION ALL SELECT 'today', symbol, datetime, close FROM ticks "
        "WHERE datetime >= TIMESTAMP '2024-01-30' AND datetime < TIMESTAMP '2024-01-31' UNION ALL "
        "SELECT 'realtime', symbol, datetime, close FROM ticks WHERE datetime > TIMESTAMP '2024-01-30 23:53:00' "
        "AND datetime <= TIMESTAMP '2024-01-30 23:58:00'", "ticks"),
    "read_csv_bars": sql(f"SELECT {', '.join(_BAR)} FROM bars", "bars"),
    "read_symbol_list": "SELECT s_name AS symbol FROM supplier WHERE s_suppkey % 10 <> 0",
}
