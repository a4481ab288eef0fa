"""Raw, clean and derived layers as DataFrame-to-DataFrame stages over all symbols at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom import fixed
from tapeloom.functions.columns import item, kept, price_order_broken
from tapeloom.operators.joins import PRICES, asof_join, factor_ratio
from tapeloom.operators.series import KEYS, flow_factors, flow_shares, over_series

MEASURES = ("net_inflow", "volume_ratio", "price_momentum_5d", "price_momentum_20d")


def _now(at) -> Column:
    return F.lit(at).cast("timestamp") if at is not None else F.current_timestamp()


def ods_bars(bars: DataFrame, source: str, at=None) -> DataFrame:
    """Stamp source, score and load times on landed bars."""
    return bars.withColumns({
        "source": F.lit(source), "quality_score": F.lit(1.0), "created_at": _now(at), "updated_at": _now(at),
    })


def bar_issues(check_turnover: bool = True) -> Column:
    """Texts of the broken rules; the price text appears once for open and once for close."""
    rules = [
        (price_order_broken("open"), fixed.BAD_PRICE_ORDER), (price_order_broken("close"), fixed.BAD_PRICE_ORDER),
        (F.col("volume") < 0, fixed.BAD_VOLUME),
    ]
    if check_turnover:
        rules.append((F.col("turnover") < 0, fixed.BAD_TURNOVER))
    return kept(*rules)


def dwd_bars(ods: DataFrame, variant: int = 1, at=None) -> DataFrame:
    """Clean bars: amount, vwap, issue list, validity.

    Variant 1 takes the close as vwap where nothing was traded and checks the turnover;
    variant 2 always takes the mean of the four prices.
    """
    mean = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    vwap = mean if variant == 2 else F.when(F.col("volume") == 0, F.col("close")).otherwise(mean)
    stamped = ods.withColumns({
        "amount": F.col("volume") * F.col("close"), "vwap": vwap,
        "quality_issues": bar_issues(check_turnover=variant == 1), "processed_at": _now(at),
    }).withColumn("is_valid", F.size("quality_issues") == 0)
    return stamped.select(
        *KEYS, "datetime", *PRICES, "volume", "turnover", "amount", "vwap", "is_valid", "quality_issues", "processed_at"
    )


def dwd_financial(ods: DataFrame, growth: bool = True, at=None) -> DataFrame:
    """Five items out of the raw maps, returns on equity and assets, growth, three rules."""
    equity, assets = F.col("shareholders_equity"), F.col("total_assets")
    out = ods.select(
        "symbol", "exchange", "report_date", "report_type",
        *[item("raw_income", c).alias(c) for c in ("total_revenue", "net_profit")],
        *[item("raw_balance", c).alias(c) for c in ("total_assets", "total_liabilities", "shareholders_equity")],
    )
    w = over_series(("exchange", "symbol", "report_type"), "report_date")

    def change(c: str) -> Column:
        rate = 100 * (F.try_divide(F.col(c), F.lag(c).over(w)) - 1)
        return F.coalesce(rate, F.lit(0.0)) if growth else F.lit(0.0)

    issues = kept(
        (F.col("total_revenue") < 0, fixed.NEGATIVE_REVENUE),
        ((F.col("net_profit") == 0) & (F.col("total_revenue") > 0), fixed.ZERO_PROFIT),
        (assets <= 0, fixed.BAD_ASSETS),
    )
    return out.withColumns({
        "revenue_growth": change("total_revenue"), "profit_growth": change("net_profit"),
        "roe": F.when(equity > 0, F.try_divide(F.col("net_profit"), equity) * 100).otherwise(0.0),
        "roa": F.when(assets > 0, F.try_divide(F.col("net_profit"), assets) * 100).otherwise(0.0),
        "quality_issues": issues, "processed_at": _now(at),
    }).withColumn("is_valid", F.size("quality_issues") == 0)


def dwd_fundamental(ods: DataFrame, at=None) -> DataFrame:
    """Five items out of the raw map and four rules."""
    names = ("pe_ratio", "pb_ratio", "ps_ratio", "market_cap", "circulating_cap")
    out = ods.select("symbol", "exchange", "date", *[item("raw_data", c).alias(c) for c in names])
    issues = kept(
        (F.col("pe_ratio") < 0, fixed.NEGATIVE_PE), (F.col("pb_ratio") < 0, fixed.NEGATIVE_PB),
        (F.col("market_cap") <= 0, fixed.BAD_CAP), (F.col("circulating_cap") > F.col("market_cap"), fixed.FLOAT_OVER_CAP),
    )
    return out.withColumns({"quality_issues": issues, "processed_at": _now(at)}).withColumn(
        "is_valid", F.size("quality_issues") == 0
    )


def _source(kind: str, *parts: str) -> Column:
    return F.concat_ws("_", F.lit(kind), *parts)


def dws_adjusted(dwd: DataFrame, factors: DataFrame | None = None, at=None) -> DataFrame:
    """Prices under the forward and the backward factor; without a factor both are 1."""
    return adjusted_by(rated(dwd, factors), at)


def rated(dwd: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """The bars and their forward ``ratio``, from which ``adjusted_by`` has all else."""
    bars = dwd.select(*KEYS, "datetime", *PRICES)
    if factors is None:
        return bars.withColumn("ratio", F.lit(1.0))
    return factor_ratio(bars, factors).select(*bars.columns, "ratio")


def rated_by_series(dwd: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """``rated`` with one shuffle of the bars for join and window together, if it is planned inside ``sinks.without_reshuffle``.

    A series is then one task's, so it is for bars, whose series end with the calendar.
    """
    if factors is None:
        return rated(dwd)
    return rated(dwd.repartition("exchange", "symbol"), factors.repartition("exchange", "symbol"))


def adjusted_by(rated: DataFrame, at=None) -> DataFrame:
    """Prices under the forward ``ratio`` and its inverse; without one both are 1."""
    rated = rated.withColumns({
        "qfq_factor": F.coalesce("ratio", F.lit(1.0)), "hfq_factor": F.coalesce(F.try_divide(F.lit(1.0), F.col("ratio")), F.lit(1.0)),
    })
    sides = {f"{c}_{s}": F.col(c) * F.col(f"{s}_factor") for s in ("qfq", "hfq") for c in PRICES}
    return rated.withColumns(sides).select(
        *KEYS, "datetime", *sides, "qfq_factor", "hfq_factor", _now(at).alias("adjusted_at"),
        _source("dwd_bars", "symbol", "exchange", "interval").alias("source_dwd"),
    )


def unique_factors(factors: DataFrame) -> DataFrame:
    """Of several factors of one series and time the greatest, so that a bar joined with them stays one row."""
    return factors.groupBy("exchange", "symbol", "datetime").agg(F.max("adj_factor").alias("adj_factor"))


def along_series(bars: DataFrame, factors: DataFrame | None, tasks: int) -> DataFrame:
    """All that the four layers take from a bar: its own columns (``own_columns``), its ``ratio`` and its ``measured`` columns.

    For bars that lie by exchange and symbol over ``tasks`` tasks, planned inside ``sinks.without_reshuffle``: they are not
    shuffled.
    """
    known = [*KEYS, "datetime", *PRICES, "volume"]
    others = [c for c in bars.columns if c not in known]
    own = [F.struct(*others).alias("own")] if others else []
    rows = bars.select(*known, *own)
    if factors is None:
        rows = rows.withColumn("ratio", F.lit(1.0))
    else:
        series = ["exchange", "symbol"]
        rows = factor_ratio(rows, unique_factors(factors.repartition(tasks, *series))).select(*rows.columns, "ratio")
    return flow_factors(rows).select(*rows.columns, *MEASURES)


def own_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """The bars as they were before ``along_series``."""
    top = {*KEYS, "datetime", *PRICES, "volume"}
    return rows.select(*[F.col(c) if c in top else F.col(f"own.`{c}`").alias(c) for c in names])


def dws_flow_factors(dwd: DataFrame, at=None) -> DataFrame:
    return factors_by(measured(dwd), at)


def measured(dwd: DataFrame) -> DataFrame:
    """The four measures that take other rows of a series; ``factors_by`` has all else from them."""
    return flow_factors(dwd.select(*KEYS, "datetime", "close", "volume")).select(*KEYS, "datetime", *MEASURES)


def factors_by(measures: DataFrame, at=None) -> DataFrame:
    """The factor layer of bars with their ``measured`` columns."""
    return flow_shares(measures).select(
        "symbol", "exchange", "datetime", "net_inflow", "main_inflow", "retail_inflow", "volume_ratio",
        "price_volume_ratio", "price_momentum_5d", "price_momentum_20d", _now(at).alias("calculated_at"),
        _source("dwd_bars", "symbol", "exchange", "interval").alias("source_dwd"),
    )


def dws_merged(financial: DataFrame, fundamentals: DataFrame, at=None) -> DataFrame:
    """Growth, returns and margin per report, with price ratios from the as-of market cap."""
    valued = asof_join(
        financial.drop("quality_issues"), fundamentals.select("exchange", "symbol", "date", "market_cap"),
        ["exchange", "symbol"], "report_date", "date", ["market_cap"],
    )
    cap = F.col("market_cap")
    return valued.select(
        "symbol", "exchange", "report_date", F.try_divide(cap, F.col("net_profit")).alias("pe_ratio"),
        F.try_divide(cap, F.col("shareholders_equity")).alias("pb_ratio"),
        F.try_divide(cap, F.col("total_revenue")).alias("ps_ratio"), F.lit(0.0).alias("pcf_ratio"),
        F.col("revenue_growth").alias("revenue_growth_yoy"), F.col("profit_growth").alias("profit_growth_yoy"),
        "roe", "roa", F.lit(0.0).alias("gross_margin"),
        F.coalesce(F.try_divide(F.col("net_profit"), F.col("total_revenue")) * 100, F.lit(0.0)).alias("net_margin"),
        _now(at).alias("merged_at"), _source("dwd_financial", "symbol", "exchange").alias("source_dwd"),
    )
