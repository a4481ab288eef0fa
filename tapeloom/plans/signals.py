"""Selection programs: universe, prices, factors, fundamentals, scores, weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tapeloom import fixed
from tapeloom.operators import crosssection as xs
from tapeloom.operators import series
from tapeloom.operators.joins import asof_join, tradable_only
from tapeloom.session import materialize

FACTORS = ["momentum_120", "volatility_20", "pe_ttm"]
CustomFactor = Callable[[WindowSpec], Column]


def month_end_rows(df: DataFrame, until: str, keys=("symbol",), order: str = "trade_date") -> DataFrame:
    """Repeat every row for the month ends at which it is the newest row of its key.

    The month ends from a row's date up to the day before the next row come from a date
    sequence, so the grid of keys and dates is never built.
    """
    after = F.coalesce(F.lead(order).over(series.over_series(keys, order)), F.date_add(F.lit(until).cast("date"), 1))
    first = F.last_day(order)
    spans = df.withColumns({"_from": first, "_to": F.date_sub(after, 1)}).filter(F.col("_from") <= F.col("_to"))
    months = F.sequence(F.trunc("_from", "month"), F.trunc("_to", "month"), F.expr("interval 1 month"))
    ends = F.filter(F.transform(months, F.last_day), lambda d: d <= F.col("_to"))
    return spans.withColumn("asof_date", F.explode(ends)).drop("_from", "_to")


def factor_frame(
    prices: DataFrame, fundamentals: DataFrame, universe: DataFrame, until: str, custom: dict[str, CustomFactor] | None = None
) -> DataFrame:
    """Cross-sections at every month end up to ``until``: keys, three factors, custom ones, industry, cap.

    A custom factor is a name and a function from the window of a symbol's price rows, in time order, to a column;
    it shares the shuffle of the built-in ones. Rows with any missing value are dropped, as the fundamentals are joined.
    """
    custom = custom or {}
    tradable = tradable_only(prices if custom else prices.select("symbol", "trade_date", "close"), universe)
    window = series.over_series(("symbol",), "trade_date")
    rolled = series.rolling_factors(tradable).withColumns({name: factor(window) for name, factor in custom.items()})
    rows = month_end_rows(rolled, until)
    rows = rows.filter("momentum_120 is not null and volatility_20 is not null").select(
        "symbol", "asof_date", "momentum_120", "volatility_20", *custom
    )
    known = asof_join(rows, fundamentals.select("symbol", "date", "pe_ttm"), ["symbol"], "asof_date", "date", ["pe_ttm"])
    meta = universe.select("symbol", "industry", F.col("free_float_mkt_cap").alias("mkt_cap"))
    joined = known.join(meta, "symbol").na.drop("any")
    return joined.select(F.col("asof_date").alias("trade_date"), "symbol", *FACTORS, *custom, "industry", "mkt_cap")


def score_factors(
    factors: DataFrame, by=("trade_date",), p: float = 0.01, cap: str | None = "mkt_cap", columns: list[str] | None = None
) -> DataFrame:
    """Winsorized, standardized, neutralized factor scores (columns keep their names)."""
    return xs.standard_scores(factors, list(by), columns or FACTORS, "industry", cap, p)


def select_daily(
    factors: DataFrame, universe: DataFrame, top_n: int = 50, tau: float = 0.15, cap: float = 0.05, by=("trade_date",)
) -> DataFrame:
    """Score, rank and weight every date's cross-section at once."""
    signed = tradable_only(factors, universe).withColumns({
        "volatility_20": -F.col("volatility_20"), "pe_ttm": -F.col("pe_ttm"),
    })
    scored = score_factors(materialize(signed), by).withColumn("score", xs.composite_equal())
    best = xs.top_n(scored.select(*by, "symbol", "score"), list(by), top_n)
    weighted = xs.softmax_weight(best, list(by), tau=tau, cap=cap)
    return weighted.select(
        *by, "symbol", "score", "rank", F.lit(1).alias("direction"), "weight",
        F.lit(fixed.MODEL_NAME).alias("model_name"), F.lit(fixed.MODEL_VERSION).alias("version"),
    )


def build_signals(
    prices: DataFrame, fundamentals: DataFrame, universe: DataFrame, until: str, top_n: int = 50, **weighting
) -> DataFrame:
    """The flagship program: signals at every month end up to ``until``."""
    return select_daily(factor_frame(prices, fundamentals, universe, until), universe, top_n, **weighting)


def screen_stocks(
    df: DataFrame, min_cap: float = 1e8, min_volume: float = 1e6, min_pe: float = 0.0, max_pe: float = 100.0
) -> DataFrame:
    """Size, volume and PE limits, each only where its column exists."""
    limits = {
        "market_cap": F.col("market_cap") >= min_cap, "volume": F.col("volume") >= min_volume,
        "pe_ttm": (F.col("pe_ttm") > min_pe) & (F.col("pe_ttm") < max_pe),
    }
    for name, keep in limits.items():
        if name in df.columns:
            df = df.filter(keep)
    return df


def screen_where(df: DataFrame, conditions: list[Column]) -> DataFrame:
    """Rows for which all conditions of the caller hold; a null does not hold."""
    for condition in conditions:
        df = df.filter(condition)
    return df


def select_weighted(factors: DataFrame, top_n: int = 50, weights: dict[str, float] | None = None, by=("trade_date",)) -> DataFrame:
    """The older form: weighted score, direction 'long', equal weights."""
    scored = score_factors(materialize(factors), by).withColumn("score", xs.composite_weighted(weights))
    best = xs.equal_weight(xs.top_n(scored.select(*by, "symbol", "score"), list(by), top_n), list(by))
    return best.withColumn("direction", F.lit("long"))


def ts_zscore(df: DataFrame, columns: list[str], keys=("symbol",), p: float = 0.01) -> DataFrame:
    """Winsorize and standardize over each symbol's own history."""
    keys = list(keys)
    return xs.zscore(xs.winsorize(df, keys, columns, p), keys, columns)


def select_with_rules(
    factors: DataFrame, universe: DataFrame, top_n: int = 50, weights: dict[str, float] | None = None,
    exclude: tuple[str, ...] = ("is_st", "is_suspended", "is_limit_up", "is_limit_down"),
    max_industry_weight: float | None = None, tau: float = 0.15, cap: float = 0.05, by=("trade_date",),
) -> DataFrame:
    """Selection under declared rules: exclusion flags, factor weights, industry cap."""
    by = list(by)
    allowed = universe
    for flag in exclude:
        allowed = allowed.filter(~F.col(flag))
    kept = factors.join(allowed.select("symbol"), "symbol", "left_semi")
    scored = score_factors(materialize(kept), by).withColumn("score", xs.composite_weighted(weights))
    best = xs.softmax_weight(xs.top_n(scored.select(*by, "symbol", "industry", "score"), by, top_n), by, tau=tau, cap=cap)
    return best if max_industry_weight is None else xs.industry_weight_cap(best, by, max_industry_weight)


def validate_signals(df: DataFrame, by=("trade_date", "model_name")) -> DataFrame:
    """Checks per date and model: weights near one, ranks in order, columns and numeric types."""
    needed = {"trade_date", "symbol", "score", "rank", "direction", "weight", "model_name", "version"}
    types = dict(df.dtypes)
    numeric = all(types.get(c) in ("double", "float", "int", "bigint") for c in ("score", "rank", "weight"))
    order = Window.partitionBy(*by).orderBy(F.col("score").desc_nulls_last(), "symbol")
    seen = df.withColumn("_fall", F.lag("rank").over(order) > F.col("rank"))
    return seen.groupBy(*by).agg(
        F.lit(needed <= set(df.columns)).alias("has_columns"), F.lit(numeric).alias("numeric_types"),
        (F.abs(F.sum("weight") - 1.0) <= 0.01).alias("weights_sum_to_one"),
        (F.count_if("_fall") == 0).alias("ranks_in_order"),
    )
