"""Queries of projections, filters and normalization."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom import fixed
from tapeloom.functions import columns as fx
from tapeloom.operators import events, normalize, summaries
from tapeloom.plans import signals
from tapeloom.registry.base_sql import define, sql
from tapeloom.registry.common import on_tables, r, rq
from tapeloom.sources import scans

# Landed vendor rows: line items as text under vendor names, many per symbol and date.
define("vendor_rows", [], """
SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS close,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS volume, l_discount,
  row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
    ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rn FROM lineitem""")

_SEQ = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def _vendor(t):
    return t.raw("lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("日期"),
        F.try_divide("l_extendedprice", "l_quantity").alias("收盘"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("成交量"), *_SEQ, "l_discount",
    )


def _landed(t):
    price = F.try_divide("l_extendedprice", "l_quantity")
    return t.raw("lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("date"),
        price.alias("open"), price.alias("high"), price.alias("low"),
        F.when(F.col("l_discount") > 0.08, 0.0).otherwise(price).alias("close"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("volume"), *_SEQ,
    )


def _listed(t):
    """Supplier keys as exchange-style symbols."""
    key = F.col("s_suppkey")
    text = F.lpad(key.cast("string"), 6, "0")
    return t.raw("supplier").select(
        key, F.when(key % 4 == 0, F.concat(text, F.lit(".sz"))).when(key % 4 == 1, F.concat(text, F.lit(".HK")))
        .when(key % 4 == 2, F.concat(F.lit("6"), text)).otherwise(F.concat(F.lit("A"), text)).alias("code"),
    )


QUERIES = {
    "normalize_vendor": on_tables(lambda t: normalize.normalize_vendor(_vendor(t), "akshare", ["symbol"], _SEQ)),
    "coerce_numeric": on_tables(lambda t: t.raw("conversations").select(
        "conv_id", "turn", fx.to_number(F.element_at(F.split("text", " "), 1)).alias("first_word"),
        fx.to_number(F.concat(F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 0, ".5").otherwise("x"))).alias("mixed"))),
    "to_utc": on_tables(lambda t: t.raw("events").select(
        "event_id", fx.to_utc("ts").alias("utc"),
        fx.to_utc(F.col("ts").cast("timestamp"), "Asia/Shanghai").cast("timestamp_ntz").alias("from_shanghai"))),
    "clean_ohlcv": on_tables(lambda t: normalize.clean_ohlcv(_landed(t), ["symbol"], _SEQ).select(
        "symbol", "date", "close", "volume")),
    "bars_frame": on_tables(lambda t: normalize.bars_frame(
        t.bars().withColumn("seq", F.lit(0)).unionByName(t.bars_update().withColumn("seq", F.lit(1))), ["seq"]).select(
        "exchange", "symbol", "datetime", "close", "volume")),
    "financials_frame": on_tables(lambda t: normalize.spread_extras(
        t.ods_financial().select("symbol", "report_date", "report_type", "raw_balance"), "raw_balance",
        ["total_assets", "total_liabilities"]).select("symbol", "report_date", "report_type", r("total_assets", 2), r("total_liabilities", 3))),
    "fundamentals_frame": on_tables(lambda t: normalize.spread_extras(
        t.ods_fundamental().select("symbol", "date", "raw_data"), "raw_data", ["pe_ratio", "circulating_cap"])),
    "event_frames": on_tables(lambda t: normalize.lists_to_text(
        normalize.text_to_lists(normalize.lists_to_text(
            t.announcements().withColumn("keywords", F.transform("keywords", lambda k: F.replace(k, F.lit(","), F.lit("")))), ["keywords"]), ["keywords"]),
        ["keywords"]).select("doc_id", "keywords")),
    "normalize_symbol": on_tables(lambda t: normalize.valid_symbols(t.raw("customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 10 == 0, "   ").otherwise(F.concat(F.lit("  "), F.lower("c_name"), F.lit(" "))).alias("symbol")))),
    "exchange_of_symbol": on_tables(lambda t: _listed(t).select("code", fx.exchange_of("code").alias("exchange"))),
    "period_of_date": on_tables(lambda t: t.raw("orders").select(
        "o_orderkey", fx.report_period("o_orderdate").alias("period"))),
    "screen_stocks": on_tables(lambda t: signals.screen_stocks(
        t.prices().join(t.fundamentals().withColumnRenamed("date", "trade_date"), ["symbol", "trade_date"]),
        min_cap=2e9, min_volume=40, max_pe=40).select("symbol", "trade_date", "close", "volume", "pe_ttm", "market_cap")),
    "tradable_filter": on_tables(lambda t: t.universe().filter("is_tradable").select("symbol", "industry", "free_float_mkt_cap")),
    "filter_announcements": on_tables(lambda t: events.announcements(t.announcements(), "risk", 4).select(F.lit("risk").alias("part"), "doc_id").union(
        events.important_announcements(t.announcements()).select(F.lit("important"), "doc_id"))),
    "filter_news": on_tables(lambda t: events.news(t.news(), "positive").select(F.lit("positive").alias("part"), "doc_id").union(
        events.news(t.news(), "negative").select(F.lit("negative"), "doc_id")).union(events.news(t.news()).select(F.lit("all"), "doc_id"))),
    "filter_reports": on_tables(lambda t: events.reports(t.reports(), rating="buy").select(F.lit("buy").alias("part"), "report_id").union(
        events.reports(t.reports(), rating="sell").select(F.lit("sell"), "report_id")).union(
        events.reports(t.reports(), kind="upgrade").select(F.lit("upgrade"), "report_id"))),
    "filter_flows": on_tables(lambda t: events.flows(t.flows(), "main").select("flow_type", "flow_id").union(
        events.flows(t.flows(), "institution").select("flow_type", "flow_id"))),
    "filter_themes": on_tables(lambda t: events.themes(t.themes(), "concept").select("theme_type", "theme_id").union(
        events.themes(t.themes(), "sector").select("theme_type", "theme_id"))),
    "filter_top_traders": on_tables(lambda t: events.top_traders(t.top_traders(), "daily").select("symbol", "date", r("net_amount", 2))),
    "members_min_weight": on_tables(lambda t: events.members_min_weight(t.index_members()).select("index_code", "symbol", r("weight", 9))),
    "industry_at_level": on_tables(lambda t: events.industry_at_level(t.industry(), "level2", "sw").select("symbol", "industry_code", "industry_name")),
    "macro_by_type": on_tables(lambda t: events.macro_by_type(t.macro(), ["money_supply", "cpi"]).select("data_code", "date", "value")),
    "valuation_cols": on_tables(lambda t: normalize.project_existing(t.fundamentals(), fixed.VALUATION_COLUMNS)),
    "profitability_cols": on_tables(lambda t: normalize.project_existing(
        t.financials().withColumn("roe", F.try_divide("net_profit", "total_equity")).withColumn(
            "net_margin", F.try_divide("net_profit", "revenue")), fixed.PROFITABILITY_COLUMNS, ("symbol", "report_date")).select(
        "symbol", "report_date", r("roe", 8), r("net_margin", 8))),
    "fundamental_growth_cols": on_tables(lambda t: normalize.project_existing(
        t.macro().withColumnsRenamed({"change_rate": "revenue_growth", "data_code": "symbol"}), fixed.GROWTH_COLUMNS).select(
        "symbol", "date", r("revenue_growth", 6))),
    "bars_between": on_tables(lambda t: scans.scan_range(t.bars(), start="1997-01-01", end="1997-12-31").select("exchange", "symbol", "datetime", "open", "close")),
    "load_range": on_tables(lambda t: scans.scan_range(t.financials(), "report_date", "1997-01-01", "1998-12-31").select("symbol", "report_date", r("total_assets", 2))),
    "events_by": on_tables(lambda t: events.audit_by(t.audit(), kind="purchase").select(F.lit("type").alias("part"), "event_id").union(
        events.audit_by(t.audit(), user=7).select(F.lit("user"), "event_id")).union(
        events.audit_by(t.audit(), asset="42").select(F.lit("asset"), "event_id")).union(
        events.audit_by(t.audit(), latest=100).select(F.lit("latest"), "event_id"))),
    "order_asc": on_tables(lambda t: t.bars().orderBy("exchange", "symbol", "datetime").select("exchange", "symbol", "datetime", "close")),
    "order_desc": on_tables(lambda t: t.flows().orderBy(F.col("date").desc(), "flow_id").select("flow_id", "date")),
    "top_members": on_tables(lambda t: events.top_members(t.index_members(), 10).select("index_code", "symbol", r("weight", 9))),
    "union_files": on_tables(lambda t: t.bars().drop("open_interest").unionByName(t.bars_update().drop("turnover"), allowMissingColumns=True).select(
        "exchange", "symbol", "datetime", "close", r("turnover", 2), "open_interest")),
    "dedup_keep_last": on_tables(lambda t: normalize.dedup_keep_last(
        t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"),
        ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])),
    "count_duplicates": on_tables(lambda t: normalize.count_duplicates(t.raw("lineitem").select("l_orderkey", "l_linenumber"))),
    "distinct_values": on_tables(lambda t: summaries.distinct_values(
        t.reports(), ["symbol"], "institution", "institutions").select("symbol", F.array_join("institutions", ",").alias("institutions"))),
    "scalar_math": on_tables(lambda t: t.fundamentals().select(
        "symbol", "date", F.round(F.ln(F.col("market_cap") + 1e-8), 9).alias("log_cap"), F.round(F.exp(F.col("pe_ttm") / 50), 9).alias("e"),
        F.round(F.sqrt("pb_ratio"), 9).alias("root"), F.greatest(F.lit(10.0), F.least(F.lit(40.0), F.col("ps_ratio"))).alias("clipped"))),
    "scalar_text": on_tables(lambda t: t.raw("customer").select(
        "c_custkey", F.lower("c_name").alias("lowered"), F.contains(F.lower("c_name"), F.lit("#00000001")).alias("has"),
        F.startswith("c_mktsegment", F.lit("B")).alias("starts"), F.replace("c_name", F.lit("#"), F.lit("-")).alias("replaced"),
        F.array_join(F.split("c_name", "#"), "/").alias("rejoined"))),
    "scalar_date": on_tables(lambda t: t.raw("events").select(
        "event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.weekday("ts").alias("w"), F.to_date("ts").alias("d"),
        F.date_add(F.to_date("ts"), -30).alias("back"), F.date_format("ts", "yyyyMMdd").alias("text"))),
    "scalar_map": on_tables(lambda t: t.ods_fundamental().select(
        "symbol", "date", fx.item("raw_data", "pe_ratio").alias("pe"), fx.item("raw_data", "pcf_ratio").alias("absent"),
        F.array_contains(F.map_keys("raw_data"), "ps_ratio").alias("has_ps"))),
}

_LIST = """
SELECT code, CASE WHEN upper(code) LIKE '%.SZ' THEN 'SZSE' WHEN upper(code) LIKE '%.SH' THEN 'SSE'
  WHEN upper(code) LIKE '%.HK' THEN 'HKEX' WHEN code LIKE '6%' THEN 'SSE'
  WHEN substring(code, 1, 1) IN ('0', '2', '3') THEN 'SZSE' ELSE 'NASDAQ' END AS exchange
FROM (SELECT CASE s_suppkey % 4 WHEN 0 THEN k || '.sz' WHEN 1 THEN k || '.HK' WHEN 2 THEN '6' || k ELSE 'A' || k END AS code
      FROM (SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS k FROM supplier))"""

ORACLE = {
    "normalize_vendor": sql(
        "SELECT symbol, date, CAST(NULL AS DOUBLE) AS open, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS DOUBLE) AS low, close, "
        "volume FROM vendor_rows WHERE rn = 1", "vendor_rows"),
    "coerce_numeric": "SELECT conv_id, turn, coalesce(TRY_CAST(split_part(text, ' ', 1) AS DOUBLE), 0) AS first_word, "
        "CASE WHEN turn % 2 = 0 THEN turn + 0.5e0 ELSE 0 END AS mixed FROM conversations",
    "to_utc": "SELECT event_id, ts AS utc, ts - INTERVAL 8 HOUR AS from_shanghai FROM events",
    "clean_ohlcv": sql(
        "SELECT symbol, date, close, coalesce(volume, 0) AS volume FROM vendor_rows WHERE rn = 1 AND l_discount <= 0.08e0 AND close > 0",
        "vendor_rows"),
    "bars_frame": sql(
        "SELECT exchange, symbol, datetime, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY exchange, symbol, datetime "
        "ORDER BY seq DESC) AS rn FROM (SELECT *, 0 AS seq FROM bars UNION ALL SELECT *, 1 FROM bars_update)) WHERE rn = 1",
        "bars", "bars_update"),
    "financials_frame": sql(
        f"SELECT symbol, report_date, report_type, {rq('total_assets', 2, 'total_assets')}, "
        f"{rq('total_liabilities', 3, 'total_liabilities')} FROM financials", "financials"),
    "fundamentals_frame": sql(
        "SELECT symbol, date, pe_ratio, market_cap * 0.8e0 AS circulating_cap FROM fundamentals", "fundamentals"),
    "event_frames": sql(
        "SELECT doc_id, array_to_string(list_transform(keywords, lambda k: replace(k, ',', '')), ',') AS keywords FROM announcements",
        "announcements"),
    "normalize_symbol": "SELECT c_custkey, upper(trim(c_name)) AS symbol FROM customer WHERE c_custkey % 10 <> 0",
    "exchange_of_symbol": _LIST,
    "period_of_date": "SELECT o_orderkey, CASE month(o_orderdate) WHEN 3 THEN 'q1' WHEN 6 THEN 'q2' WHEN 9 THEN 'q3' ELSE 'annual' "
        "END AS period FROM orders",
    "screen_stocks": sql(
        "SELECT p.symbol, trade_date, close, volume, pe_ttm, market_cap FROM prices p JOIN fundamentals f ON p.symbol = f.symbol "
        "AND trade_date = date WHERE market_cap >= 2e9 AND volume >= 40 AND pe_ttm > 0 AND pe_ttm < 40", "prices", "fundamentals"),
    "tradable_filter": sql("SELECT symbol, industry, free_float_mkt_cap FROM universe WHERE is_tradable", "universe"),
    "filter_announcements": sql(
        "SELECT 'risk' AS part, doc_id FROM announcements WHERE announcement_type = 'risk' AND importance >= 4 UNION ALL "
        "SELECT 'important', doc_id FROM announcements WHERE is_important", "announcements"),
    "filter_news": sql(
        "SELECT sentiment AS part, doc_id FROM news WHERE confidence >= 0.5 AND sentiment <> 'neutral' UNION ALL "
        "SELECT 'all', doc_id FROM news WHERE confidence >= 0.5", "news"),
    "filter_reports": sql(
        "SELECT rating AS part, report_id FROM reports WHERE rating IN ('buy', 'sell') UNION ALL "
        "SELECT report_type, report_id FROM reports WHERE report_type = 'upgrade'", "reports"),
    "filter_flows": sql("SELECT flow_type, flow_id FROM flows WHERE flow_type IN ('main', 'institution')", "flows"),
    "filter_themes": sql("SELECT theme_type, theme_id FROM themes WHERE theme_type IN ('concept', 'sector')", "themes"),
    "filter_top_traders": sql(f"SELECT symbol, date, {rq('net_amount', 2, 'net_amount')} FROM top_traders", "top_traders"),
    "members_min_weight": sql(f"SELECT index_code, symbol, {rq('weight', 9, 'weight')} FROM index_members WHERE weight >= 0.01", "index_members"),
    "industry_at_level": sql("SELECT symbol, industry_code, industry_name FROM industry WHERE industry_level = 'level2'", "industry"),
    "macro_by_type": sql("SELECT data_code, date, value FROM macro WHERE data_code IN ('M2', 'CPI')", "macro"),
    "valuation_cols": sql("SELECT symbol, date, pe_ratio, pe_ttm, pb_ratio, ps_ratio FROM fundamentals", "fundamentals"),
    "profitability_cols": sql(
        f"SELECT symbol, report_date, {rq('net_profit / total_equity', 8, 'roe')}, {rq('net_profit / revenue', 8, 'net_margin')} FROM financials",
        "financials"),
    "fundamental_growth_cols": sql(
        f"SELECT data_code AS symbol, date, {rq('change_rate', 6, 'revenue_growth')} FROM macro", "macro"),
    "bars_between": sql("SELECT exchange, symbol, datetime, open, close FROM bars WHERE datetime BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'", "bars"),
    "load_range": sql(
        f"SELECT symbol, report_date, {rq('total_assets', 2, 'total_assets')} FROM financials WHERE report_date BETWEEN "
        "DATE '1997-01-01' AND DATE '1998-12-31'", "financials"),
    "events_by": sql(
        "SELECT 'type' AS part, event_id FROM audit WHERE event_type = 'purchase' UNION ALL SELECT 'user', event_id FROM audit "
        "WHERE user_id = 7 UNION ALL SELECT 'asset', event_id FROM audit WHERE asset_id = '42' UNION ALL SELECT 'latest', event_id "
        "FROM (SELECT event_id FROM audit ORDER BY timestamp DESC, event_id LIMIT 100)", "audit"),
    "order_asc": sql("SELECT exchange, symbol, datetime, close FROM bars ORDER BY 1, 2, 3", "bars"),
    "order_desc": sql("SELECT flow_id, date FROM flows ORDER BY date DESC, flow_id", "flows"),
    "top_members": sql(
        f"SELECT index_code, symbol, {rq('weight', 9, 'weight')} FROM (SELECT *, row_number() OVER (PARTITION BY index_code ORDER BY "
        "weight DESC, symbol) AS rn FROM index_members) WHERE rn <= 10", "index_members"),
    "union_files": sql(
        f"SELECT exchange, symbol, datetime, close, {rq('turnover', 2, 'turnover')}, open_interest FROM (SELECT exchange, symbol, "
        "datetime, close, turnover, CAST(NULL AS DOUBLE) AS open_interest FROM bars UNION ALL SELECT exchange, symbol, datetime, "
        "close, NULL, open_interest FROM bars_update)", "bars", "bars_update"),
    "dedup_keep_last": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER "
        "(PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1",
    "count_duplicates": "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicate_count FROM lineitem",
    "scalar_math": sql(
        "SELECT symbol, date, round(ln(market_cap + 1e-8), 9) AS log_cap, round(exp(pe_ttm / 50), 9) AS e, round(sqrt(pb_ratio), 9) AS root, "
        "greatest(10e0, least(40e0, ps_ratio)) AS clipped FROM fundamentals", "fundamentals"),
    "scalar_text": "SELECT c_custkey, lower(c_name) AS lowered, contains(lower(c_name), '#00000001') AS has, starts_with(c_mktsegment, 'B') AS starts, "
        "replace(c_name, '#', '-') AS replaced, replace(c_name, '#', '/') AS rejoined FROM customer",
    "scalar_date": "SELECT event_id, year(ts) AS y, month(ts) AS m, isodow(ts) - 1 AS w, CAST(ts AS DATE) AS d, CAST(ts AS DATE) - 30 AS back, "
        "strftime(ts, '%Y%m%d') AS text FROM events",
    "scalar_map": sql("SELECT symbol, date, pe_ratio AS pe, 0e0 AS absent, true AS has_ps FROM fundamentals", "fundamentals"),
    "distinct_values": sql(
        "SELECT symbol, array_to_string(list_sort(list(DISTINCT institution)), ',') AS institutions FROM reports WHERE institution <> '' GROUP BY 1",
        "reports"),
}
