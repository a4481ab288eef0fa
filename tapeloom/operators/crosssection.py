"""Cross-section operators: every trade date at once, no date gathered in one task.

Each operator aggregates the statistics of a date with map-side combining and joins them
back. No broadcast is forced: adaptive execution measures the statistics table, broadcasts
it where it is small and splits a date that holds much of the rows where it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom import fixed
from tapeloom.functions.quantiles import matched, wide_quantiles


def _back(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Left join on null-safe keys, keeping the columns of ``df`` first."""
    return matched(df, stats, by, "left")


def winsorize(
    df: DataFrame, by: list[str], columns: list[str], p: float = 0.01, accuracy: int = 10_000, bounded: bool = True
) -> DataFrame:
    """Clip each column to its exact p and 1-p quantiles within ``by``.

    A group of a cross-section is bounded by the number of symbols, a daily series by the calendar: one
    exact percentile aggregate serves all columns. For groups of any size set ``bounded`` to False.
    """
    if bounded and by:
        wide = group_percentiles(df, by, columns, [p, 1 - p])
    else:
        wide = wide_quantiles(df, by, columns, [p, 1 - p], accuracy=accuracy)
    joined = _back(df, wide, by)
    clipped = {
        c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_q1_{c}")), F.col(f"_q0_{c}")))
        for c in columns
    }
    return joined.withColumns(clipped).select(*df.columns)


def group_percentiles(df: DataFrame, by: list[str], columns: list[str], probs: list[float]) -> DataFrame:
    """Exact quantiles ``_q<i>_<column>`` per bounded group, in one aggregate."""
    asked = F.array(*[F.lit(p) for p in probs])
    found = df.groupBy(*by).agg(*[F.percentile(F.col(c).cast("double"), asked).alias(f"_p_{c}") for c in columns])
    return found.select(*by, *[F.col(f"_p_{c}")[i].alias(f"_q{i}_{c}") for c in columns for i in range(len(probs))])


def standard_scores(
    df: DataFrame, by: list[str], columns: list[str], industry: str = "industry", cap: str | None = "mkt_cap", p: float = 0.01
) -> DataFrame:
    """neutralize(zscore(winsorize(df))) in two aggregates.

    The z-score is affine within a date and the fit has an intercept per industry, so the residual
    of the z-score is the residual of the clipped values over their deviation. One aggregate per date and
    industry holds counts, means, squared deviations and co-moments; those of the date follow from them.
    """
    clipped = winsorize(df, by, columns, p)
    x = F.lit(0.0) if cap is None else F.coalesce(F.ln(F.col(cap) + 1e-8), F.lit(0.0))
    clipped = clipped.withColumn("_x", x)
    n = F.count("*")
    groups = clipped.groupBy(*by, industry).agg(
        n.alias("_rows"), F.avg("_x").alias("_mx"), (F.var_pop("_x") * n).alias("_xx"),
        *[f for c in columns for f in (
            F.count(c).alias(f"_c_{c}"), F.avg(c).alias(f"_m_{c}"), (F.var_pop(c) * F.count(c)).alias(f"_yy_{c}"),
            (F.covar_pop("_x", c) * F.count(c)).alias(f"_xy_{c}"))],
    )
    date = Window.partitionBy(*by)
    groups = groups.withColumns({f"_a_{c}": F.sum(F.col(f"_c_{c}") * F.col(f"_m_{c}")).over(date) / F.sum(f"_c_{c}").over(date) for c in columns})
    xx = F.sum("_xx").over(date)

    def deviation(c: str) -> Column:
        between = F.col(f"_c_{c}") * (F.col(f"_m_{c}") - F.col(f"_a_{c}")) * (F.col(f"_m_{c}") - F.col(f"_a_{c}"))
        return F.sqrt(F.try_divide(F.sum(F.col(f"_yy_{c}") + between).over(date), F.sum(f"_c_{c}").over(date) - 1))

    per_date = {}
    for c in columns:
        per_date |= {
            f"_s_{c}": deviation(c), f"_n_{c}": F.sum(F.col("_rows") - F.col(f"_c_{c}")).over(date),
            f"_b_{c}": F.when(xx > 1e-12, F.sum(f"_xy_{c}").over(date) / xx).otherwise(0.0),
        }
    joined = _back(clipped, groups.withColumns(per_date), [*by, industry])

    def score(c: str) -> Column:
        residual = F.col(c) - F.col(f"_m_{c}") - F.col(f"_b_{c}") * (F.col("_x") - F.col("_mx"))
        return F.try_divide(F.when(F.col(f"_n_{c}") > 0, F.col(c) - F.col(f"_a_{c}")).otherwise(residual), F.col(f"_s_{c}"))

    return joined.withColumns({c: score(c) for c in columns}).select(*df.columns)


def zscore(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(x - mean) / sample deviation within ``by``; null where the deviation is 0 or unknown."""
    stats = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns]
    )
    joined = _back(df, stats, by)
    scaled = {c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}
    return joined.withColumns(scaled).select(*df.columns)


def neutralize(
    df: DataFrame, by: list[str], columns: list[str], industry: str = "industry", cap: str | None = "mkt_cap"
) -> DataFrame:
    """Residual of a least-squares fit on industry dummies and log cap, within ``by``.

    Closed form: with y and x demeaned by industry, the slope is sum(xy) / sum(xx) over the
    date. A missing cap counts as regressor 0, a missing industry is a group of its own. A
    date with a missing y cannot be fitted: its column stays as it is.
    """
    if cap is None:
        regressed, x = df, None
    else:
        regressed, x = df.withColumn("_x", F.coalesce(F.ln(F.col(cap) + 1e-8), F.lit(0.0))), "_x"
    means = [F.avg(c).alias(f"_m_{c}") for c in columns]
    missing = [F.count_if(F.col(c).isNull()).alias(f"_z_{c}") for c in columns]
    moments = []
    if x:
        moments = [F.avg(x).alias("_mx"), (F.var_pop(x) * F.count("*")).alias("_xx")] + [
            (F.covar_pop(x, c) * F.count("*")).alias(f"_xy_{c}") for c in columns
        ]
    groups = regressed.groupBy(*by, industry).agg(*means, *missing, *moments)
    # One row per date and industry from here on.
    date = Window.partitionBy(*by)
    per_date = {f"_n_{c}": F.sum(f"_z_{c}").over(date) for c in columns}
    if x:
        xx = F.sum("_xx").over(date)
        per_date |= {
            f"_b_{c}": F.when(xx > 1e-12, F.sum(f"_xy_{c}").over(date) / xx).otherwise(0.0) for c in columns
        }
    joined = _back(regressed, groups.withColumns(per_date), [*by, industry])

    def residual(c: str) -> Column:
        r = F.col(c) - F.col(f"_m_{c}")
        if x:
            r = r - F.col(f"_b_{c}") * (F.col(x) - F.col("_mx"))
        return F.when(F.col(f"_n_{c}") > 0, F.col(c)).otherwise(r)

    return joined.withColumns({c: residual(c) for c in columns}).select(*df.columns)


def neutralize_mean(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The plain form: subtract the mean within ``by``."""
    stats = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    joined = _back(df, stats, by)
    return joined.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).select(*df.columns)


def steady(score: Column) -> Column:
    """Twelve decimals: names that differ by rounding noise only are tied, and ties go by symbol."""
    return F.round(score, 12) + F.lit(0.0)


def composite_equal(momentum="momentum_120", volatility="volatility_20", pe="pe_ttm") -> Column:
    """Mean of three scores that are already signed (low volatility and low PE positive)."""
    return steady((F.col(momentum) + F.col(volatility) + F.col(pe)) / 3)


def composite_weighted(weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of factor scores; the defaults are the fixed factor weights."""
    total = F.lit(0.0)
    for name, weight in (weights or fixed.FACTOR_WEIGHTS).items():
        total = total + F.col(name) * F.lit(weight)
    return steady(total)


def top_n(df: DataFrame, by: list[str], n: int, score: str = "score", out: str = "rank") -> DataFrame:
    """Best n per ``by``, ranked 1..n; ties by symbol. Pruned in every task before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), "symbol")
    return df.withColumn(out, F.row_number().over(order)).filter(F.col(out) <= n)


def softmax_weight(
    selected: DataFrame, by: list[str], score: str = "score", tau: float = 0.15, cap: float = 0.05, rounds: int = 1,
    out: str = "weight",
) -> DataFrame:
    """exp(score / tau) as shares, clipped at ``cap`` and made to sum to one again.

    Clipping once can leave weights above the cap; more ``rounds`` repeat it. For a selected
    list of at most n rows per date.
    """
    date = Window.partitionBy(*by)
    e = F.exp((F.col(score) - F.max(score).over(date)) / tau)
    df = selected.withColumn("_e", e)
    df = df.withColumn(out, F.try_divide(F.col("_e"), F.sum("_e").over(date))).drop("_e")
    for _ in range(rounds):
        df = df.withColumn(out, F.least(F.col(out), F.lit(cap)))
        df = df.withColumn(out, F.try_divide(F.col(out), F.sum(out).over(date)))
    return df


def equal_weight(selected: DataFrame, by: list[str], out: str = "weight") -> DataFrame:
    return selected.withColumn(out, 1.0 / F.count("*").over(Window.partitionBy(*by)))


def industry_weight_cap(selected: DataFrame, by: list[str], cap: float, industry: str = "industry", out: str = "weight") -> DataFrame:
    """Scale down the weights of an industry whose sum exceeds ``cap``; the rest stays in cash."""
    total = F.sum(out).over(Window.partitionBy(*by, industry))
    return selected.withColumn(out, F.when(total > cap, F.col(out) * cap / total).otherwise(F.col(out)))


def is_rank_monotonic(df: DataFrame, by: list[str], score: str = "score", rank: str = "rank") -> DataFrame:
    """One row per ``by``: the rank never falls in score order."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), "symbol")
    falls = df.withColumn("_fall", F.lag(rank).over(order) > F.col(rank))
    return falls.groupBy(*by).agg((F.count_if("_fall") == 0).alias("monotonic"))
