"""Queries of the cross-section operators and selection programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import crosssection as xs
from tapeloom.operators import joins, summaries
from tapeloom.plans import signals
from tapeloom.registry.base_sql import define, sql
from tapeloom.registry.common import UNTIL, on_tables, r, rq
from tapeloom.session import materialize

F3 = ("momentum_120", "volatility_20", "pe_ttm")
DATE = ["trade_date"]

define("month_ends", [], f"""
SELECT CAST(last_day(m) AS DATE) AS asof_date
FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '{UNTIL}', INTERVAL 1 MONTH) t(m)""")
define("tradable_prices", ["prices", "universe"], """
SELECT p.* FROM prices p WHERE symbol IN (SELECT symbol FROM universe WHERE is_tradable)""")
define("rolling", ["tradable_prices"], """
SELECT symbol, trade_date, close / lag(close, 119) OVER w - 1 AS momentum_120,
  CASE WHEN row_number() OVER w >= 20 THEN stddev_samp(ret) OVER (w ROWS 19 PRECEDING) END AS volatility_20
FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS ret FROM tradable_prices)
WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)""")
define("factors", ["rolling", "month_ends", "fundamentals", "universe"], """
SELECT g.asof_date AS trade_date, g.symbol, momentum_120, volatility_20, pe_ttm, industry,
  free_float_mkt_cap AS mkt_cap
FROM (SELECT d.asof_date, s.symbol FROM month_ends d, (SELECT DISTINCT symbol FROM rolling) s) g
ASOF JOIN rolling r ON g.symbol = r.symbol AND g.asof_date >= r.trade_date
ASOF JOIN (SELECT symbol, date, pe_ttm FROM fundamentals) f ON g.symbol = f.symbol AND g.asof_date >= f.date
JOIN universe u ON g.symbol = u.symbol
WHERE momentum_120 IS NOT NULL AND volatility_20 IS NOT NULL AND pe_ttm IS NOT NULL""")


def define_scores(out: str, source: str, signs: tuple[int, int, int]) -> None:
    """SQL of winsorize, z-score and neutralize for the three factors."""
    signed = ", ".join(f"{s} * {c} AS {c}" for c, s in zip(F3, signs))
    define(f"{out}_raw", [source], f"SELECT trade_date, symbol, industry, mkt_cap, {signed} FROM {source}")
    cols = ", ".join(f"greatest(least({c}, hi_{i}), lo_{i}) AS {c}" for i, c in enumerate(F3))
    bounds = ", ".join(
        f"quantile_cont({c}, 0.01e0) AS lo_{i}, quantile_cont({c}, 0.99e0) AS hi_{i}" for i, c in enumerate(F3)
    )
    define(f"{out}_win", [f"{out}_raw"], f"""
SELECT trade_date, symbol, industry, mkt_cap, {cols} FROM {out}_raw
JOIN (SELECT trade_date, {bounds} FROM {out}_raw GROUP BY 1) USING (trade_date)""")
    zs = ", ".join(f"({c} - avg({c}) OVER d) / nullif(stddev_samp({c}) OVER d, 0) AS {c}" for c in F3)
    define(f"{out}_z", [f"{out}_win"], f"""
SELECT trade_date, symbol, industry, ln(mkt_cap + 1e-8) AS x, {zs} FROM {out}_win WINDOW d AS (PARTITION BY trade_date)""")
    dm = ", ".join(f"{c} - avg({c}) OVER g AS y{i}" for i, c in enumerate(F3))
    miss = ", ".join(f"count(*) FILTER ({c} IS NULL) OVER (PARTITION BY trade_date) AS m{i}" for i, c in enumerate(F3))
    define(f"{out}_dm", [f"{out}_z"], f"""
SELECT *, x - avg(x) OVER g AS xd, {dm}, {miss} FROM {out}_z WINDOW g AS (PARTITION BY trade_date, industry)""")
    res = ", ".join(
        f"CASE WHEN m{i} > 0 THEN {c} WHEN sum(xd * xd) OVER d > 1e-12 THEN y{i} - sum(xd * y{i}) OVER d / "
        f"sum(xd * xd) OVER d * xd ELSE y{i} END AS {c}" for i, c in enumerate(F3)
    )
    define(out, [f"{out}_dm"], f"SELECT trade_date, symbol, industry, {res} FROM {out}_dm WINDOW d AS (PARTITION BY trade_date)")


define_scores("scored", "factors", (1, -1, -1))
define_scores("scored_plain", "factors", (1, 1, 1))
define("signals", ["scored"], """
SELECT *, w2 / sum(w2) OVER (PARTITION BY trade_date) AS weight FROM (
SELECT *, least(e / sum(e) OVER (PARTITION BY trade_date), 0.05e0) AS w2 FROM (
SELECT *, exp((score - max(score) OVER (PARTITION BY trade_date)) / 0.15e0) AS e FROM (
SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, symbol) AS rank FROM (
SELECT trade_date, symbol, round((momentum_120 + volatility_20 + pe_ttm) / 3, 12) + 0 AS score FROM scored)) WHERE rank <= 50))""")
define("weighted", ["scored_plain"], """
SELECT *, 1e0 / count(*) OVER (PARTITION BY trade_date) AS weight FROM (
SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, symbol) AS rank FROM (
SELECT trade_date, symbol, industry, round(0 + momentum_120 * 0.4e0 + volatility_20 * -0.3e0 + pe_ttm * -0.3e0, 12) + 0 AS score
FROM scored_plain)) WHERE rank <= 50""")


define("custom_rows", ["factors", "tradable_prices"], """
SELECT f.trade_date, f.symbol, f.industry, p.x FROM factors f ASOF JOIN (SELECT symbol, trade_date,
  1 - close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY trade_date) AS x FROM tradable_prices) p
ON f.symbol = p.symbol AND f.trade_date >= p.trade_date""")


def _factors(t, until: str = UNTIL):
    return signals.factor_frame(t.prices(), t.fundamentals(), t.universe(), until)


def _signals(t):
    return signals.build_signals(t.prices(), t.fundamentals(), t.universe(), UNTIL)


def _broken_signals(t):
    """Signals with doubled weights in every fourth month and reversed ranks in every fifth."""
    month = F.month("trade_date")
    return _signals(t).withColumns({
        "weight": F.when(month % 4 == 0, F.col("weight") * 2).otherwise(F.col("weight")),
        "rank": F.when(month % 5 == 0, -F.col("rank")).otherwise(F.col("rank")),
    })


def _custom(t):
    """The factor table with a fourth factor of the user: the negative return of five rows."""
    reversal = {"reversal_5": lambda w: 1 - F.col("close") / F.lag("close", 5).over(w)}
    return signals.factor_frame(t.prices(), t.fundamentals(), t.universe(), UNTIL, reversal)


def _plain(t):
    """Winsorized and standardized factors, unsigned, from one materialized cross-section."""
    base = materialize(_factors(t))
    return xs.zscore(xs.winsorize(base, DATE, list(F3)), DATE, list(F3))


def _three(df, digits=6):
    return df.select("trade_date", "symbol", *[r(c, digits) for c in F3])


def _scored(t):
    return signals.score_factors(materialize(_factors(t)))


def _signed_scored(t):
    signed = _factors(t).withColumns({"volatility_20": -F.col("volatility_20"), "pe_ttm": -F.col("pe_ttm")})
    return signals.score_factors(materialize(signed))


def _rules(t):
    return signals.select_with_rules(_factors(t), t.universe(), max_industry_weight=0.2)


def _older_run(t):
    screened = signals.screen_stocks(
        joins.asof_join(
            _factors(t), t.prices().select("symbol", F.col("trade_date").alias("bar_date"), "volume"), ["symbol"],
            "trade_date", "bar_date", ["volume"],
        ), min_volume=1.0,
    )
    return signals.select_weighted(screened.select("trade_date", "symbol", *F3, "industry", "mkt_cap"))


def _history_z(t):
    rolled = t.fundamentals().select("symbol", F.col("date").alias("trade_date"), "pe_ttm", "pb_ratio")
    return signals.ts_zscore(rolled, ["pe_ttm", "pb_ratio"])


def _factors_per_symbol(t):
    """Time-standardized factors of each symbol, newest row kept."""
    from tapeloom.operators.series import latest_per_key, rolling_factors

    rolled = rolling_factors(t.prices().select("symbol", "trade_date", "close"))
    pe = t.fundamentals().select("symbol", F.col("date").alias("trade_date"), "pe_ttm")
    frame = rolled.join(pe, ["symbol", "trade_date"]).na.drop("any")
    z = signals.ts_zscore(materialize(frame.select("symbol", "trade_date", *F3)), list(F3))
    return latest_per_key(z, ["symbol"], "trade_date")


def _top_list(values):
    return F.array_join(F.transform(values, lambda x: x["symbol"]), ",")


QUERIES = {
    "build_signals": on_tables(lambda t: _signals(t).select(
        "trade_date", "symbol", r("score", 6), "rank", "direction", r("weight", 6), "model_name", "version")),
    "select_daily": on_tables(lambda t: signals.select_daily(_factors(t), t.universe(), top_n=20).select(
        "trade_date", "symbol", r("score", 6), "rank", "direction", r("weight", 6))),
    "winsorize": on_tables(lambda t: _three(xs.winsorize(materialize(_factors(t)), DATE, list(F3)), 7)),
    "zscore": on_tables(lambda t: _three(_plain(t))),
    "neutralize": on_tables(lambda t: _three(_scored(t))),
    "neutralize_industry_only": on_tables(lambda t: _three(xs.neutralize(_plain(t), DATE, list(F3), cap=None))),
    "neutralize_mean": on_tables(lambda t: _three(xs.neutralize_mean(_factors(t), DATE, list(F3)))),
    "softmax_weight": on_tables(lambda t: xs.softmax_weight(
        xs.top_n(t.fundamentals().select(F.col("date").alias("trade_date"), "symbol",
                                         (F.col("pe_ttm") / 50).alias("score")), DATE, 30), DATE,
    ).select("trade_date", "symbol", "rank", r("weight", 7))),
    "equal_weight": on_tables(lambda t: xs.equal_weight(
        xs.top_n(t.prices().select("trade_date", "symbol", F.col("close").alias("score")), DATE, 30), DATE,
    ).select("trade_date", "symbol", r("weight", 9))),
    "composite_equal": on_tables(lambda t: _signed_scored(t).select(
        "trade_date", "symbol", xs.composite_equal().alias("s")).select("trade_date", "symbol", r("s", 6, "score"))),
    "composite_weighted": on_tables(lambda t: signals.select_weighted(_factors(t)).select(
        "trade_date", "symbol", r("score", 6), "rank", r("weight", 9), "direction")),
    "older_selection_run": on_tables(lambda t: _older_run(t).select(
        "trade_date", "symbol", r("score", 6), "rank", r("weight", 9), "direction")),
    "factors_per_symbol": on_tables(lambda t: _factors_per_symbol(t).select("symbol", "trade_date", *[r(c, 6) for c in F3])),
    "ts_zscore": on_tables(lambda t: _history_z(t).select("symbol", "trade_date", r("pe_ttm", 6), r("pb_ratio", 6))),
    "config_rules": on_tables(lambda t: _rules(t).select(
        "trade_date", "symbol", "industry", r("score", 6), "rank", r("weight", 6))),
    "validate_signals": on_tables(lambda t: signals.validate_signals(_broken_signals(t))),
    "custom_factor": on_tables(lambda t: _custom(t).select("trade_date", "symbol", r("reversal_5", 8))),
    "custom_factor_scores": on_tables(lambda t: signals.score_factors(
        materialize(_custom(t)), cap=None, columns=["reversal_5"]).select("trade_date", "symbol", r("reversal_5", 6))),
    "custom_screen": on_tables(lambda t: signals.screen_where(
        t.fundamentals(), [F.col("pe_ttm") < 20, F.col("pb_ratio") > F.col("ps_ratio")]).select("symbol", "date", "pe_ttm", "pb_ratio", "ps_ratio")),
    "signal_summary": on_tables(lambda t: summaries.signal_summary(_signals(t)).select(
        "trade_date", "model_name", "total_stocks", *[r(f"score_{k}", 6) for k in ("mean", "std", "min", "max")],
        *[r(f"weight_{k}", 6) for k in ("sum", "mean", "max", "min")], _top_list(F.col("top_5")).alias("top_5"))),
    "factor_stats": on_tables(lambda t: summaries.factor_stats(_factors(t), list(F3)).select(
        *[r(f"{c}_{k}", 7) for c in F3 for k in ("mean", "std")])),
    "rank_selection": on_tables(lambda t: xs.top_n(
        t.fundamentals().select(F.col("date").alias("trade_date"), "symbol", F.col("pb_ratio").alias("score")), DATE, 50,
    ).select("trade_date", "symbol", "rank")),
    "topn_select": on_tables(lambda t: xs.top_n(
        t.prices().select("trade_date", "symbol", F.col("amount").alias("score")), DATE, 5,
    ).select("trade_date", "symbol", "rank")),
    "is_rank_monotonic": on_tables(lambda t: xs.is_rank_monotonic(
        xs.top_n(t.prices().select("trade_date", "symbol", F.col("close").alias("score")), DATE, 50).withColumn(
            "rank", F.when(F.dayofmonth("trade_date") % 3 == 0, -F.col("rank")).otherwise(F.col("rank"))), DATE)),
}

_R3 = ", ".join(rq(c, 6, c) for c in F3)
_ROUNDED = "trade_date, symbol, " + rq("score", 6, "score") + ", CAST(rank AS INTEGER) AS rank"
_SOFT = """
SELECT trade_date, symbol, rank, w2 / sum(w2) OVER (PARTITION BY trade_date) AS w FROM (
SELECT *, least(e / sum(e) OVER (PARTITION BY trade_date), 0.05e0) AS w2 FROM (
SELECT *, exp((score - max(score) OVER (PARTITION BY trade_date)) / 0.15e0) AS e FROM ({})))"""


def _ranked(source: str, score: str, n: int, date: str = "date") -> str:
    return (f"SELECT * FROM (SELECT {date} AS trade_date, symbol, {score} AS score, row_number() OVER (PARTITION BY {date} "
            f"ORDER BY {score} DESC, symbol) AS rank FROM {source}) WHERE rank <= {n}")


ORACLE = {
    "build_signals": sql(
        f"SELECT {_ROUNDED}, 1 AS direction, {rq('weight', 6, 'weight')}, 'rank_topn_neutral' AS model_name, "
        "'v1.0' AS version FROM signals", "signals"),
    "select_daily": sql(
        "SELECT trade_date, symbol, " + rq("score", 6, "score") + ", rank, 1 AS direction, " + rq("w", 6, "weight")
        + " FROM (SELECT t.*, score FROM (" + _SOFT.format("SELECT * FROM signals WHERE rank <= 20".replace("*", "trade_date, symbol, score, rank"))
        + ") t JOIN (SELECT trade_date, symbol, score FROM signals) USING (trade_date, symbol))", "signals"),
    "winsorize": sql("SELECT trade_date, symbol, " + ", ".join(rq(c, 7, c) for c in F3) + " FROM scored_plain_win", "scored_plain_win"),
    "zscore": sql(f"SELECT trade_date, symbol, {_R3} FROM scored_plain_z", "scored_plain_z"),
    "neutralize": sql(f"SELECT trade_date, symbol, {_R3} FROM scored_plain", "scored_plain"),
    "neutralize_industry_only": sql(
        "SELECT trade_date, symbol, " + ", ".join(
            rq(f"CASE WHEN m{i} > 0 THEN {c} ELSE y{i} END", 6, c) for i, c in enumerate(F3))
        + " FROM scored_plain_dm", "scored_plain_dm"),
    "neutralize_mean": sql(
        "SELECT trade_date, symbol, " + ", ".join(rq(f"{c} - avg({c}) OVER (PARTITION BY trade_date)", 6, c) for c in F3)
        + " FROM factors", "factors"),
    "softmax_weight": sql(
        "SELECT trade_date, symbol, rank, " + rq("w", 7, "weight") + " FROM (" + _SOFT.format(_ranked("fundamentals", "pe_ttm / 50", 30))
        + ")", "fundamentals"),
    "equal_weight": sql(
        "SELECT trade_date, symbol, " + rq("1e0 / count(*) OVER (PARTITION BY trade_date)", 9, "weight") + " FROM ("
        + _ranked("prices", "close", 30, "trade_date") + ")", "prices"),
    "composite_equal": sql(
        "SELECT trade_date, symbol, " + rq("(momentum_120 + volatility_20 + pe_ttm) / 3", 6, "score") + " FROM scored",
        "scored"),
    "composite_weighted": sql(
        f"SELECT {_ROUNDED}, {rq('weight', 9, 'weight')}, 'long' AS direction FROM weighted", "weighted"),
    "older_selection_run": sql(
        f"SELECT {_ROUNDED}, {rq('weight', 9, 'weight')}, 'long' AS direction FROM weighted", "weighted"),
    "factors_per_symbol": sql(
        "SELECT symbol, trade_date, " + _R3 + " FROM (SELECT symbol, trade_date, row_number() OVER (PARTITION BY symbol "
        "ORDER BY trade_date DESC) AS rn, " + ", ".join(
            f"(w{i} - avg(w{i}) OVER s) / nullif(stddev_samp(w{i}) OVER s, 0) AS {c}" for i, c in enumerate(F3))
        + " FROM (SELECT symbol, trade_date, " + ", ".join(
            f"greatest(least({c}, quantile_cont({c}, 0.99e0) OVER s), quantile_cont({c}, 0.01e0) OVER s) AS w{i}"
            for i, c in enumerate(F3))
        + " FROM (SELECT r.symbol, r.trade_date, momentum_120, volatility_20, pe_ttm FROM all_rolling r JOIN fundamentals f "
        "ON f.symbol = r.symbol AND f.date = r.trade_date WHERE momentum_120 IS NOT NULL AND volatility_20 IS NOT NULL) "
        "WINDOW s AS (PARTITION BY symbol)) WINDOW s AS (PARTITION BY symbol)) WHERE rn = 1",
        "prices", "fundamentals").replace("all_rolling r", """(
SELECT symbol, trade_date, close / lag(close, 119) OVER w - 1 AS momentum_120,
  CASE WHEN row_number() OVER w >= 20 THEN stddev_samp(ret) OVER (w ROWS 19 PRECEDING) END AS volatility_20
FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS ret FROM prices)
WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)) r"""),
    "ts_zscore": sql(
        "SELECT symbol, trade_date, " + ", ".join(
            rq(f"(w{i} - avg(w{i}) OVER s) / nullif(stddev_samp(w{i}) OVER s, 0)", 6, c)
            for i, c in enumerate(("pe_ttm", "pb_ratio")))
        + " FROM (SELECT symbol, date AS trade_date, " + ", ".join(
            f"greatest(least({c}, quantile_cont({c}, 0.99e0) OVER s), quantile_cont({c}, 0.01e0) OVER s) AS w{i}"
            for i, c in enumerate(("pe_ttm", "pb_ratio")))
        + " FROM fundamentals WINDOW s AS (PARTITION BY symbol)) WINDOW s AS (PARTITION BY symbol)", "fundamentals"),
    "config_rules": sql(
        "SELECT trade_date, symbol, industry, " + rq("score", 6, "score") + ", rank, " + rq(
            "CASE WHEN total > 0.2 THEN w * 0.2e0 / total ELSE w END", 6, "weight")
        + " FROM (SELECT *, sum(w) OVER (PARTITION BY trade_date, industry) AS total FROM (SELECT s.trade_date, s.symbol, "
        "s.rank, s.w, k.score, k.industry FROM (" + _SOFT.format("SELECT trade_date, symbol, score, rank FROM weighted")
        + ") s JOIN weighted k USING (trade_date, symbol)))", "weighted"),
    "validate_signals": sql(
        "SELECT trade_date, 'rank_topn_neutral' AS model_name, true AS has_columns, true AS numeric_types, "
        "abs(sum(weight) * CASE WHEN month(trade_date) % 4 = 0 THEN 2 ELSE 1 END - 1) <= 0.01 AS weights_sum_to_one, "
        "NOT (month(trade_date) % 5 = 0 AND count(*) > 1) AS ranks_in_order FROM signals GROUP BY 1", "signals"),
    "custom_factor": sql(
        f"SELECT f.trade_date, f.symbol, {rq('reversal_5', 8, 'reversal_5')} FROM factors f ASOF JOIN (SELECT symbol, trade_date, "
        "1 - close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY trade_date) AS reversal_5 FROM tradable_prices) p "
        "ON f.symbol = p.symbol AND f.trade_date >= p.trade_date", "factors", "tradable_prices"),
    "custom_factor_scores": sql(
        f"SELECT trade_date, symbol, {rq('CASE WHEN missing > 0 THEN z ELSE z - m END', 6, 'reversal_5')} FROM (SELECT *, avg(z) OVER (PARTITION BY trade_date, "
        "industry) AS m, count(*) FILTER (z IS NULL) OVER (PARTITION BY trade_date) AS missing FROM (SELECT trade_date, symbol, industry, (c - avg(c) OVER d) / "
        "nullif(stddev_samp(c) OVER d, 0) AS z FROM (SELECT c.trade_date, symbol, industry, greatest(least(x, hi), lo) AS c FROM custom_rows c "
        "JOIN (SELECT trade_date, quantile_cont(x, 0.01e0) AS lo, quantile_cont(x, 0.99e0) AS hi FROM custom_rows GROUP BY 1) b USING (trade_date)) "
        "WINDOW d AS (PARTITION BY trade_date)))", "custom_rows"),
    "custom_screen": sql(
        "SELECT symbol, date, pe_ttm, pb_ratio, ps_ratio FROM fundamentals WHERE pe_ttm < 20 AND pb_ratio > ps_ratio", "fundamentals"),
    "signal_summary": sql(
        "SELECT trade_date, 'rank_topn_neutral' AS model_name, count(*) AS total_stocks, " + ", ".join(
            [rq(f"{f}(score)", 6, f"score_{k}") for k, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]
            + [rq(f"{f}(weight)", 6, f"weight_{k}") for k, f in (("sum", "sum"), ("mean", "avg"), ("max", "max"), ("min", "min"))])
        + ", string_agg(symbol, ',' ORDER BY rank) FILTER (rank <= 5) AS top_5 FROM signals GROUP BY 1", "signals"),
    "factor_stats": sql("SELECT " + ", ".join(
        rq(f"{f}({c})", 7, f"{c}_{k}") for c in F3 for k, f in (("mean", "avg"), ("std", "stddev_samp"))) + " FROM factors",
        "factors"),
    "rank_selection": sql("SELECT trade_date, symbol, rank FROM (" + _ranked("fundamentals", "pb_ratio", 50) + ")", "fundamentals"),
    "topn_select": sql("SELECT trade_date, symbol, rank FROM (" + _ranked("prices", "amount", 5, "trade_date") + ")", "prices"),
    "is_rank_monotonic": sql("SELECT trade_date, NOT (day(trade_date) % 3 = 0 AND count(*) > 1) AS monotonic FROM prices GROUP BY 1", "prices"),
}
