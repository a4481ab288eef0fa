"""SQL text of the adapter tables, so that an oracle query can build the same input."""

from __future__ import annotations

import re

from tapeloom import fixed

_BARS = """
SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CASE WHEN l_suppkey % 2 = 0 THEN 'SSE' ELSE 'SZSE' END AS exchange,
  '1d' AS "interval", CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS datetime,
  arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close,
  sum(l_quantity) AS volume, sum(l_extendedprice) AS turnover, CAST(0 AS DOUBLE) AS open_interest
FROM (SELECT *, l_extendedprice / l_quantity AS p,
        (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)
GROUP BY l_suppkey, CAST(l_shipdate AS DATE)"""

_TICKS = """
SELECT event_type AS symbol, 'SSE' AS exchange, 'tick' AS "interval", ts AS datetime, value AS open, value AS high,
  value AS low, value AS close, CAST(1 AS DOUBLE) AS volume, value AS turnover, CAST(0 AS DOUBLE) AS open_interest
FROM events"""

_PRICES = """
SELECT symbol, CAST(datetime AS DATE) AS trade_date, close, open, high, low, volume, turnover AS amount,
  turnover / volume AS vwap FROM bars"""

_ADJ = """
SELECT exchange, symbol, datetime, 1 + 0.01e0 * (rn // 40) AS adj_factor
FROM (SELECT exchange, symbol, datetime,
        row_number() OVER (PARTITION BY exchange, symbol ORDER BY datetime) AS rn FROM bars)
WHERE rn % 40 = 0"""

_FIN = """
SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CASE WHEN l_suppkey % 2 = 0 THEN 'SSE' ELSE 'SZSE' END AS exchange,
  report_date, CAST(report_date + CAST(30 + l_suppkey % 30 AS INTEGER) AS DATE) AS publish_date, 'income' AS report_type,
  CASE WHEN month(report_date) = 12 THEN 'annual' ELSE 'q' || CAST(month(report_date) // 3 AS VARCHAR) END
    AS report_period,
  revenue, net_profit, total_assets, total_assets * 0.6e0 AS total_equity,
  total_assets - total_assets * 0.6e0 AS total_liabilities
FROM (SELECT l_suppkey,
        CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS report_date,
        sum(l_extendedprice * (1 - l_discount)) AS revenue,
        sum(l_extendedprice * (0.2e0 - l_discount - l_tax)) AS net_profit,
        sum(l_extendedprice) + 1e6 AS total_assets
      FROM lineitem GROUP BY 1, 2)"""

_FUND = """
SELECT symbol, exchange, CAST(datetime AS DATE) AS date,
  5 + 45 * (((CAST(symbol AS BIGINT) * 7 + ord) % 101) / 101e0) AS pe_ratio,
  5 + 45 * (((CAST(symbol AS BIGINT) * 7 + ord) % 101) / 101e0) AS pe_ttm,
  5 + 45 * (((CAST(symbol AS BIGINT) * 7 + ord) % 103) / 103e0) AS pb_ratio,
  5 + 45 * (((CAST(symbol AS BIGINT) * 7 + ord) % 107) / 107e0) AS ps_ratio,
  1e8 * (1 + CAST(symbol AS BIGINT) % 997) AS market_cap
FROM (SELECT *, date_diff('day', DATE '1970-01-01', CAST(datetime AS DATE)) AS ord FROM bars)"""

_UNIVERSE = """
SELECT *, NOT (is_st OR is_suspended OR is_limit_up OR is_limit_down) AS is_tradable FROM (
SELECT 'ALL' AS universe, CAST(s_suppkey AS VARCHAR) AS symbol, CAST(n_regionkey AS VARCHAR) AS industry,
  1e8 * (1 + s_suppkey % 997) AS free_float_mkt_cap, s_suppkey % 50 = 0 AS is_st, s_suppkey % 97 = 0 AS is_suspended,
  s_suppkey % 89 = 0 AS is_limit_up, s_suppkey % 83 = 0 AS is_limit_down,
  CAST(DATE '1995-01-01' + CAST(s_suppkey % 700 AS INTEGER) AS DATE) AS effective_date
FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

_NEWS = """
SELECT doc_id, CAST(doc_id % 50 AS VARCHAR) AS symbol, substring(text, 1, 40) AS title, text AS content,
  CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS TIMESTAMP) AS publish_date, sentiment,
  CASE sentiment WHEN 'negative' THEN -0.8e0 WHEN 'positive' THEN 0.8e0 ELSE 0e0 END AS sentiment_score,
  source, least(1e0, n_chars / 2000e0) AS confidence
FROM (SELECT d.*, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment
      FROM documents d LEFT JOIN labels USING (doc_id))"""

_ANNOUNCEMENTS = """
SELECT doc_id, CAST(doc_id % 50 AS VARCHAR) AS symbol, substring(text, 1, 40) AS title, text AS content,
  CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS TIMESTAMP) AS announcement_date,
  ['financial', 'business', 'governance', 'risk', 'other'][CAST(doc_id % 5 AS INTEGER) + 1] AS announcement_type,
  source, string_split(text, ' ')[1:3] AS keywords, CAST(1 + doc_id % 5 AS INTEGER) AS importance,
  1 + doc_id % 5 >= 4 AS is_important
FROM documents"""

_REPORTS = """
SELECT o_orderkey AS report_id, CAST(o_custkey % 100 AS VARCHAR) AS symbol,
  'Report ' || CAST(o_orderkey AS VARCHAR) AS title, o_orderdate AS publish_date,
  ['initiate', 'maintain', 'upgrade', 'downgrade', 'target'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS report_type,
  ['strong_buy', 'buy', 'hold', 'sell', 'strong_sell'][CAST(substring(o_orderpriority, 1, 1) AS INTEGER)] AS rating,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 1000 END AS target_price,
  o_totalprice / 1100 AS current_price, c_name AS analyst,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE n_name END AS institution
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

_FLOWS = """
SELECT o_orderkey AS flow_id, CAST(o_custkey % 100 AS VARCHAR) AS symbol, o_orderdate AS date,
  ['main', 'retail', 'institution', 'foreign'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS flow_type,
  CASE o_orderstatus WHEN 'O' THEN 'inflow' WHEN 'F' THEN 'outflow' ELSE 'neutral' END AS direction,
  CASE o_orderstatus WHEN 'O' THEN o_totalprice WHEN 'F' THEN -o_totalprice ELSE 0e0 END AS net_amount,
  CASE o_orderstatus WHEN 'O' THEN o_totalprice ELSE 0e0 END AS inflow_amount,
  CASE o_orderstatus WHEN 'F' THEN o_totalprice ELSE 0e0 END AS outflow_amount,
  1e0 AS volume, CAST(o_orderkey % 10 AS DOUBLE) AS turnover_rate
FROM orders"""

_THEMES = """
SELECT p_partkey AS theme_id, CAST(p_partkey % 100 AS VARCHAR) AS symbol, p_brand AS theme_name,
  CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'concept' WHEN p_type IN ('LARGE', 'STANDARD') THEN 'sector'
    WHEN p_type = 'MEDIUM' THEN 'industry' ELSE 'region' END AS theme_type,
  p_size / 50e0 AS weight
FROM part"""

_TRADERS = """
SELECT symbol, date, 'daily' AS dragon_tiger_type, 'volume' AS reason, buy_amount, sell_amount,
  buy_amount - sell_amount AS net_amount,
  coalesce(list_transform(list_sort(bs)[1:5], lambda x: CAST(x AS VARCHAR)), []) AS buy_seats,
  coalesce(list_transform(list_sort(ss)[1:5], lambda x: CAST(x AS VARCHAR)), []) AS sell_seats,
  qty / 100 AS turnover_rate, hi / lo AS price_change
FROM (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS date,
        sum(CASE WHEN l_returnflag IN ('R', 'N') THEN l_extendedprice ELSE 0e0 END) AS buy_amount,
        sum(CASE WHEN l_returnflag IN ('A', 'N') THEN l_extendedprice ELSE 0e0 END) AS sell_amount,
        list(DISTINCT l_partkey) FILTER (l_returnflag IN ('R', 'N')) AS bs,
        list(DISTINCT l_partkey) FILTER (l_returnflag IN ('A', 'N')) AS ss,
        sum(l_quantity) AS qty, max(l_extendedprice / l_quantity) AS hi, min(l_extendedprice / l_quantity) AS lo
      FROM lineitem GROUP BY 1, 2)"""

_MEMBERS = """
SELECT index_code, 'Index ' || index_code AS index_name, 'sector' AS index_type, symbol, symbol_name,
  market_cap / sum(market_cap) OVER (PARTITION BY index_code) AS weight, market_cap, effective_date, end_date,
  end_date IS NULL AS is_active
FROM (SELECT CAST(n_regionkey AS VARCHAR) AS index_code, CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS symbol_name,
        1e8 * (1 + s_suppkey % 997) AS market_cap,
        CAST(DATE '1995-01-01' + CAST(s_suppkey % 700 AS INTEGER) AS DATE) AS effective_date,
        CASE WHEN s_suppkey % 5 = 0 THEN CAST(DATE '1995-01-01' + CAST(s_suppkey % 700 + 400 AS INTEGER) AS DATE) END
          AS end_date
      FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

_INDUSTRY = """
SELECT *, end_date IS NULL AS is_active FROM (
SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS symbol_name, 'sw' AS industry_standard,
  CAST(DATE '1995-01-01' + CAST(s_suppkey % 700 AS INTEGER) AS DATE) AS effective_date,
  CASE WHEN s_suppkey % 5 = 0 THEN CAST(DATE '1995-01-01' + CAST(s_suppkey % 700 + 400 AS INTEGER) AS DATE) END
    AS end_date,
  'level' || CAST(lv AS VARCHAR) AS industry_level,
  CASE lv WHEN 1 THEN CAST(r_regionkey AS VARCHAR) WHEN 2 THEN CAST(n_nationkey AS VARCHAR)
    ELSE CAST(s_suppkey % 7 AS VARCHAR) END AS industry_code,
  CASE lv WHEN 1 THEN r_name WHEN 2 THEN n_name ELSE 'CLASS_' || CAST(s_suppkey % 7 AS VARCHAR) END AS industry_name,
  CASE lv WHEN 2 THEN CAST(r_regionkey AS VARCHAR) WHEN 3 THEN CAST(n_nationkey AS VARCHAR) END
    AS parent_industry_code,
  CASE lv WHEN 2 THEN r_name WHEN 3 THEN n_name END AS parent_industry_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey,
  (VALUES (1), (2), (3)) t(lv))"""

_MACRO = """
SELECT data_code, data_type, 'monthly' AS frequency, date, value, 'thousand' AS unit, previous_value,
  value - previous_value AS change_value, (value - previous_value) / nullif(previous_value, 0) * 100 AS change_rate
FROM (SELECT *, lag(value) OVER (PARTITION BY data_code ORDER BY date) AS previous_value FROM (
  SELECT ['GDP', 'CPI', 'PPI', 'M2', 'UNEMPLOYMENT'][CAST(substring(o_orderpriority, 1, 1) AS INTEGER)] AS data_code,
    ['gdp', 'cpi', 'ppi', 'money_supply', 'unemployment'][CAST(substring(o_orderpriority, 1, 1) AS INTEGER)]
      AS data_type,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS date, round(sum(o_totalprice) / 1000, 5) AS value
  FROM orders GROUP BY 1, 2, 3))"""

_EDGES = """
SELECT 'r' || n_regionkey AS source_id, 'n' || n_nationkey AS target_id, 'data_flow' AS edge_type FROM nation
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'data_flow' FROM customer
UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'data_flow' FROM orders"""

_NODES = """
SELECT 'region_' || (r_regionkey % 25) AS dataset_id, 'r' || r_regionkey AS node_id, 'provider' AS node_type FROM region
UNION ALL SELECT 'nation_' || (n_nationkey % 25), 'n' || n_nationkey, 'store' FROM nation
UNION ALL SELECT 'customer_' || (c_custkey % 25), 'c' || c_custkey, 'service' FROM customer
UNION ALL SELECT 'order_' || (o_orderkey % 25), 'o' || o_orderkey, 'store' FROM orders"""

_METRICS = """
SELECT CASE event_type WHEN 'error' THEN 'api_error_rate' WHEN 'view' THEN 'storage_usage_percent'
    WHEN 'click' THEN 'data_age_hours' WHEN 'purchase' THEN 'data_quality_score' ELSE 'other' END AS name,
  CASE event_type WHEN 'error' THEN value / 5000 WHEN 'view' THEN value / 5 WHEN 'click' THEN value / 10
    WHEN 'purchase' THEN 1 - value / 500 ELSE value END AS value, ts AS timestamp, event_id
FROM events"""

_ASSETS = """
SELECT 'a' || o_orderkey AS asset_id, o_orderdate AS created_at,
  ['permanent', 'years_7', 'years_1', 'days_30'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS policy_id FROM orders"""

_AUDIT = """
SELECT event_id, event_type, ts AS timestamp, user_id, json_extract_string(props, '$.k') AS asset_id, props AS details
FROM events"""

_UPDATE = """
SELECT * REPLACE (close * 1.01e0 AS close) FROM bars WHERE day(datetime) >= 25
UNION ALL
SELECT * REPLACE (datetime + INTERVAL 1 DAY AS datetime) FROM bars
WHERE (exchange, symbol, datetime) IN (SELECT (exchange, symbol, max(datetime)) FROM bars GROUP BY exchange, symbol)"""

# name -> (tables it needs, text)
CTES: dict[str, tuple[list[str], str]] = {
    "bars": ([], _BARS), "ticks": ([], _TICKS), "prices": (["bars"], _PRICES), "adj_factor": (["bars"], _ADJ),
    "financials": ([], _FIN), "fundamentals": (["bars"], _FUND), "universe": ([], _UNIVERSE), "news": ([], _NEWS),
    "announcements": ([], _ANNOUNCEMENTS), "reports": ([], _REPORTS), "flows": ([], _FLOWS), "themes": ([], _THEMES),
    "top_traders": ([], _TRADERS), "index_members": ([], _MEMBERS), "industry": ([], _INDUSTRY),
    "macro": ([], _MACRO), "lineage_edges": ([], _EDGES), "lineage_nodes": ([], _NODES), "metrics": ([], _METRICS),
    "assets": ([], _ASSETS), "audit": ([], _AUDIT), "bars_update": (["bars"], _UPDATE),
}


def define(name: str, needs: list[str], text: str) -> None:
    """Add a shared intermediate table for oracle queries."""
    CTES[name] = (needs, text)


W = "PARTITION BY exchange, symbol ORDER BY datetime"
define("adjusted", ["bars", "adj_factor"], """
SELECT exchange, symbol, datetime, open, high, low, close, f, f / last_value(f) OVER w AS qfq, last_value(f) OVER w / f AS hfq
FROM (SELECT b.*, last_value(adj_factor IGNORE NULLS) OVER (PARTITION BY exchange, symbol ORDER BY datetime) AS f
      FROM bars b LEFT JOIN adj_factor a USING (exchange, symbol, datetime))
WINDOW w AS (PARTITION BY exchange, symbol ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
define("dwd_fin", ["financials"], """
SELECT *, 100 * net_profit / total_equity AS roe, 100 * net_profit / total_assets AS roa,
  coalesce(100 * (revenue / lag(revenue) OVER w - 1), 0) AS revenue_growth,
  coalesce(100 * (net_profit / lag(net_profit) OVER w - 1), 0) AS profit_growth
FROM financials WINDOW w AS (PARTITION BY exchange, symbol, report_type ORDER BY report_date)""")
define("flow_windows", ["bars"], f"""
SELECT exchange, symbol, datetime, ni, vr, m5, m20 FROM (
SELECT *, coalesce((close - lag(close) OVER ({W})) * volume / 1e6, 0) AS ni,
  CASE WHEN row_number() OVER ({W}) > 20 THEN volume / avg(volume) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
    ELSE 1e0 END AS vr,
  coalesce((close - lag(close, 5) OVER ({W})) / lag(close, 5) OVER ({W}), 0) AS m5,
  coalesce((close - lag(close, 20) OVER ({W})) / lag(close, 20) OVER ({W}), 0) AS m20 FROM bars)""")


def sql(body: str, *tables: str, recursive: bool = False) -> str:
    """``body`` under a WITH clause that defines ``tables`` and all they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in CTES[name][0]:
                visit(need)
            order.append(name)

    for table in tables:
        visit(table)
    parts = [f"{name} AS MATERIALIZED ({CTES[name][1].strip()})" for name in order]
    head = "WITH RECURSIVE " if recursive else "WITH "
    lead = body.lstrip()
    if lead.upper().startswith("WITH "):
        return with_fixed_texts(head + ",\n".join([*parts, lead[5:]]))
    return with_fixed_texts((head + ",\n".join(parts) + "\n" + lead) if parts else lead)


def with_fixed_texts(text: str) -> str:
    """``@NAME@`` stands for the fixed text of that name."""
    return re.sub("@([A-Z_]+)@", lambda m: getattr(fixed, m[1]), text)
