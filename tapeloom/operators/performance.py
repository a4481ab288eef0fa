"""Profit of a signal and its summary; the definitions are this library's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.operators.series import KEYS, over_series


def signal_pnl(
    df: DataFrame, shares: int = 1000, cost_bp: float = 12.0, signal: str = "signal", keys=KEYS, order: str = "datetime"
) -> DataFrame:
    """Position = signal x shares; PnL = held position x price change less cost on the traded value.

    ``cost_bp`` is fee plus slip per traded value; pass a delayed signal to avoid look-ahead.
    """
    w = over_series(keys, order)
    held = df.withColumn("position", F.col(signal) * shares)
    before = F.coalesce(F.lag("position").over(w), F.lit(0))
    move = F.col("close") - F.coalesce(F.lag("close").over(w), F.col("close"))
    cost = (cost_bp / 10000) * F.abs(F.col("position") - before) * F.col("close")
    return held.withColumn("pnl", before * move - cost)


def performance_summary(
    pnl: DataFrame, capital: float = 1e6, risk_free: float = 0.02, days: int = 252, keys=KEYS, order: str = "datetime"
) -> DataFrame:
    """Per series: total and mean PnL, deviation, annual return and volatility, Sharpe, drawdown."""
    upto = over_series(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    curve = pnl.withColumn("_cum", F.sum("pnl").over(upto))
    curve = curve.withColumn("_down", F.col("_cum") - F.max("_cum").over(upto))
    out = curve.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("mean_pnl"),
        F.stddev_samp("pnl").alias("std_pnl"), F.min("_down").alias("max_drawdown"),
    )
    out = out.withColumns({
        "annual_return": F.col("mean_pnl") / capital * days,
        "annual_volatility": F.col("std_pnl") / capital * F.sqrt(F.lit(float(days))),
        "drawdown_ratio": F.col("max_drawdown") / capital,
    })
    return out.withColumn("sharpe", F.try_divide(F.col("annual_return") - risk_free, F.col("annual_volatility")))
