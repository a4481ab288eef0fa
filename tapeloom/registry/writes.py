"""Queries of sinks: write, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import layers
from tapeloom.operators.profile import pivot_close
from tapeloom.operators.upsert import BAR_KEY, FUNDAMENTAL_KEY, STATEMENT_KEY, upsert
from tapeloom.plans import lake, signals
from tapeloom.registry import selection as _selection  # noqa: F401 - defines the SQL of factors and signals
from tapeloom.registry.base_sql import sql
from tapeloom.registry.common import UNTIL, minutes, on_tables, r, rq
from tapeloom.session import settings
from tapeloom.sinks import tables as sinks
from tapeloom.sources.adapters import Tables

_KEY = ["exchange", "symbol", "datetime"]


def _back(t: Tables, name: str, write):
    """Write to a fresh folder of the shared directory and read it back."""
    path = sinks.scratch_path(t.spark, name)
    write(path)
    return sinks.read_table(t.spark, path)


def _tick_update(t: Tables):
    """Later half of every minute restated, an outdated copy first."""
    return _with_copies(t.ticks().filter(F.second("datetime") >= 30).withColumn("close", F.col("close") + 1), "close")


def _with_copies(new, value: str):
    """Every row of an update twice: an outdated value, then the one that counts."""
    return new.withColumn("seq", F.lit(0)).withColumn(value, F.col(value) * 3 + 7).unionByName(new.withColumn("seq", F.lit(1)))


def _year_table(t: Tables):
    """Bars table in year partitions, then one late batch merged into it."""
    path = sinks.scratch_path(t.spark, "bars")
    parts = ["exchange", "interval", "year"]
    sinks.write_table(sinks.with_period(t.bars(), "datetime", monthly=False), path, parts, ["symbol", "datetime"])
    late = t.bars_update().filter(F.col("datetime") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    sinks.upsert_table(t.spark, path, sinks.with_period(_with_copies(late, "close"), "datetime", monthly=False), BAR_KEY, parts, ["seq"], cluster=["symbol", "datetime"])
    return sinks.read_table(t.spark, path)


def _fin_update(t: Tables):
    return _with_copies(t.financials().filter(F.month("report_date") == 12).withColumn("revenue", F.col("revenue") * 2), "revenue")


def _fund_update(t: Tables):
    return _with_copies(t.fundamentals().filter(F.dayofmonth("date") >= 28).withColumn("pe_ttm", F.col("pe_ttm") + 1), "pe_ttm")


def _events(t: Tables):
    """Six event tables written with a load day; one of them reloaded on a later day."""
    plan = [
        ("announcements", t.announcements(), "announcement_date", "doc_id"), ("news", t.news(), "publish_date", "doc_id"),
        ("reports", t.reports(), "publish_date", "report_id"), ("flows", t.flows(), "date", "flow_id"),
        ("themes", t.themes(), "theme_id", "theme_id"), ("top_traders", t.top_traders(), "date", None),
    ]
    out = None
    for name, df, time, key in plan:
        path = sinks.scratch_path(t.spark, name)
        sinks.write_events(df, path, "2024-12-01", time)
        if name == "flows":
            sinks.write_events(df.filter("direction = 'inflow'"), path, "2024-12-02", time)
        stored = sinks.read_latest_load(t.spark, path, [key] if key else ["symbol", "date"], [])
        part = stored.select(F.lit(name).alias("name"), "load_date", F.col(key if key else "symbol").cast("string").alias("id"))
        out = part if out is None else out.union(part)
    return out


def _purged(t: Tables):
    path = sinks.scratch_path(t.spark, "purge")
    sinks.write_table(sinks.with_period(t.bars(), "datetime", monthly=False), path, ["year"], ["symbol", "datetime"])
    sinks.purge_table(t.spark, path, "2001-12-31", 1095, "datetime", ["year"])
    return sinks.read_table(t.spark, path)


def _json(t: Tables):
    path = sinks.scratch_path(t.spark, "audit")
    sinks.export_events_json(t.audit(), path, "2024-01-10", "2024-01-20")
    return t.spark.read.schema("event_id bigint, event_type string, user_id bigint, asset_id string, details string").json(path)


def _csv(t: Tables):
    path = sinks.scratch_path(t.spark, "pivot")
    closes = pivot_close(t.prices())
    sinks.export_csv(closes, path)
    return t.spark.read.option("header", True).schema(closes.schema).csv(path)


def _dws(t: Tables):
    tasks = t.series_tasks()
    dwd = layers.dwd_bars(layers.ods_bars(t.bars(tasks), "lake")).select(*layers.KEYS, "datetime", *layers.PRICES, "volume")
    by_month = lake.by_month(dwd, t.adj_factor(), tasks)

    def derived(name, df, parts):
        return _back(t, name, lambda p: sinks.write_table(sinks.with_period(df, "datetime"), p, parts, ["symbol", "datetime"], rebalance=False))

    with settings(t.spark, lake.SMALL_SPLITS):
        adjusted = derived("dws_adjusted", layers.adjusted_by(by_month), lake.BAR_PARTS)
        factors = derived("dws_factors", layers.factors_by(by_month), lake.PARTS["dws_factors"])
    merged = _back(t, "dws_merged", lambda p: sinks.write_statements(
        layers.dws_merged(layers.dwd_financial(t.ods_financial()), t.fundamentals()), p))

    def rows(name, df, time, value):
        return df.select(F.lit(name).alias("layer"), "exchange", "symbol", F.col(time).cast("date").alias("day"), value.alias("value"), "year")

    return rows("adjusted", adjusted, "datetime", F.col("close_qfq")).union(rows("factors", factors, "datetime", F.col("net_inflow"))).union(
        rows("merged", merged, "report_date", r("roe", 6)))


def _written_signals(t: Tables):
    s = signals.build_signals(t.prices(), t.fundamentals(), t.universe(), UNTIL)
    return _back(t, "signals", lambda p: sinks.write_signals(s, p))


def _written_selection(t: Tables):
    chosen = signals.select_weighted(signals.factor_frame(t.prices(), t.fundamentals(), t.universe(), UNTIL))
    return _back(t, "selection", lambda p: sinks.write_signals(chosen, p, "weighted"))


QUERIES = {
    "upsert_bars": on_tables(lambda t: upsert(t.bars(), _with_copies(t.bars_update(), "close"), BAR_KEY, ["seq"]).select(*_KEY, "close", "volume")),
    "upsert_minutes": on_tables(lambda t: upsert(minutes(t), _tick_update(t), BAR_KEY, ["seq", "close"]).select("symbol", "datetime", "close")),
    "upsert_financial": on_tables(lambda t: upsert(t.financials(), _fin_update(t), STATEMENT_KEY, ["seq"]).select("symbol", "report_date", r("revenue", 4))),
    "upsert_fundamental": on_tables(lambda t: upsert(t.fundamentals(), _fund_update(t), FUNDAMENTAL_KEY, ["seq"]).select("symbol", "date", "pe_ttm")),
    "upsert_table": on_tables(lambda t: _year_table(t).select(*_KEY, "close", "year")),
    "write_ods": on_tables(lambda t: _back(t, "ods", lambda p: sinks.write_bars(layers.ods_bars(t.bars(), "lake"), p)).select(
        *_KEY, "interval", "close", "volume", "source", "year", "month")),
    "write_dwd": on_tables(lambda t: _back(t, "dwd", lambda p: sinks.write_bars(layers.dwd_bars(layers.ods_bars(t.bars(), "lake")), p)).select(
        *_KEY, "amount", "vwap", "is_valid", "year", "month")),
    "write_dws": on_tables(_dws),
    "write_events": on_tables(_events),
    "write_index": on_tables(lambda t: _back(t, "index", lambda p: sinks.write_by(t.index_members(), p, ["index_code"], ["symbol"])).select(
        "index_code", "symbol", r("weight", 9))),
    "write_industry": on_tables(lambda t: _back(t, "industry", lambda p: sinks.write_by(
        t.industry(), p, ["industry_standard", "industry_level"], ["symbol"])).select("symbol", "industry_standard", "industry_level", "industry_name")),
    "write_macro": on_tables(lambda t: _back(t, "macro", lambda p: sinks.write_by(
        t.macro().withColumn("year", F.year("date")), p, ["data_type", "frequency", "year"], ["data_code", "date"])).select(
        "data_code", "data_type", "date", "value", "year")),
    "write_signals": on_tables(lambda t: _written_signals(t).select("strategy", "trade_date", "symbol", "rank", r("weight", 6))),
    "write_selection": on_tables(lambda t: _written_selection(t).select("strategy", "trade_date", "symbol", "rank", r("score", 6))),
    "export_events_json": on_tables(_json),
    "export_pivot_csv": on_tables(_csv),
    "purge_expired": on_tables(lambda t: _purged(t).select(*_KEY, "close")),
}


def _merged(keys: str, new: str, columns: str, *tables: str, old: str) -> str:
    return sql(f"WITH nw AS ({new}) SELECT {columns} FROM (SELECT * FROM nw UNION ALL SELECT * FROM {old} WHERE ({keys}) NOT IN "
               f"(SELECT ({keys}) FROM nw))", *tables)


ORACLE = {
    "upsert_bars": _merged("exchange, symbol, datetime", "SELECT * FROM bars_update", "exchange, symbol, datetime, close, volume",
                           "bars", "bars_update", old="bars"),
    "upsert_minutes": sql(
        "SELECT symbol, datetime, CASE WHEN second(datetime) >= 30 THEN max(close) + 1 ELSE max(close) END AS close FROM ticks GROUP BY symbol, datetime", "ticks"),
    "upsert_financial": sql(
        f"SELECT symbol, report_date, {rq('CASE WHEN month(report_date) = 12 THEN revenue * 2 ELSE revenue END', 4, 'revenue')} FROM financials",
        "financials"),
    "upsert_fundamental": sql(
        "SELECT symbol, date, CASE WHEN day(date) >= 28 THEN pe_ttm + 1 ELSE pe_ttm END AS pe_ttm FROM fundamentals", "fundamentals"),
    "upsert_table": _merged("exchange, symbol, datetime", "SELECT * FROM bars_update WHERE datetime >= DATE '2001-01-01'",
                            "exchange, symbol, datetime, close, CAST(year(datetime) AS INTEGER) AS year", "bars", "bars_update", old="bars"),
    "write_ods": sql(
        "SELECT exchange, symbol, datetime, \"interval\", close, volume, 'lake' AS source, year(datetime) AS year, month(datetime) AS month FROM bars", "bars"),
    "write_dwd": sql(
        "SELECT exchange, symbol, datetime, volume * close AS amount, (open + high + low + close) / 4 AS vwap, true AS is_valid, "
        "year(datetime) AS year, month(datetime) AS month FROM bars", "bars"),
    "write_dws": sql(
        f"SELECT 'adjusted' AS layer, exchange, symbol, CAST(datetime AS DATE) AS day, close * coalesce(qfq, 1) AS value, "
        "CAST(year(datetime) AS INTEGER) AS year FROM adjusted UNION ALL "
        f"SELECT 'factors', exchange, symbol, CAST(datetime AS DATE), ni, CAST(year(datetime) AS INTEGER) FROM flow_windows UNION ALL "
        f"SELECT 'merged', exchange, symbol, CAST(report_date AS DATE), {rq('roe', 6, 'value')}, CAST(year(report_date) AS INTEGER) FROM dwd_fin",
        "adjusted", "flow_windows", "dwd_fin"),
    "write_events": sql(
        "SELECT name, DATE '2024-12-01' AS load_date, id FROM (" + " UNION ALL ".join(
            f"SELECT '{n}' AS name, CAST({k} AS VARCHAR) AS id FROM {n}" + (" WHERE direction <> 'inflow'" if n == "flows" else "")
            for n, k in (("announcements", "doc_id"), ("news", "doc_id"), ("reports", "report_id"), ("flows", "flow_id"), ("themes", "theme_id"),
                         ("top_traders", "symbol")))
        + ") UNION ALL SELECT 'flows', DATE '2024-12-02', CAST(flow_id AS VARCHAR) FROM flows WHERE direction = 'inflow'",
        "announcements", "news", "reports", "flows", "themes", "top_traders"),
    "write_index": sql(f"SELECT index_code, symbol, {rq('weight', 9, 'weight')} FROM index_members", "index_members"),
    "write_industry": sql("SELECT symbol, industry_standard, industry_level, industry_name FROM industry", "industry"),
    "write_macro": sql("SELECT data_code, data_type, date, value, year(date) AS year FROM macro", "macro"),
    "write_signals": sql(
        f"SELECT 'rank_topn_neutral' AS strategy, trade_date, symbol, rank, {rq('weight', 6, 'weight')} FROM signals", "signals"),
    "write_selection": sql(f"SELECT 'weighted' AS strategy, trade_date, symbol, rank, {rq('score', 6, 'score')} FROM weighted", "weighted"),
    "export_events_json": sql(
        "SELECT event_id, event_type, user_id, asset_id, details FROM audit WHERE timestamp BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'",
        "audit"),
    "export_pivot_csv": sql("SELECT trade_date, symbol, close FROM prices", "prices"),
    "purge_expired": sql("SELECT exchange, symbol, datetime, close FROM bars WHERE datetime >= DATE '2001-12-31' - 1095", "bars"),
}
