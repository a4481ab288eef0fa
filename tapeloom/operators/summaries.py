"""Grouped summaries of signals, events, members, classes and macro series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom import fixed


def top_k_list(df: DataFrame, by: list[str], order: list[Column], k: int, fields: list[str], out: str) -> DataFrame:
    """The k first rows per group as an array; pruned to k rows before they are gathered."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    few = df.withColumn("_rn", rn).filter(F.col("_rn") <= k)
    packed = F.array_sort(F.collect_list(F.struct("_rn", *fields)))
    return few.groupBy(*by).agg(packed.alias(out))


def signal_summary(signals: DataFrame, by=("trade_date", "model_name")) -> DataFrame:
    """Score and weight statistics and the five best rows per date and model."""
    by = list(by)
    stats = signals.groupBy(*by).agg(
        F.count("*").alias("total_stocks"), F.avg("score").alias("score_mean"), F.stddev_samp("score").alias("score_std"),
        F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.sum("weight").alias("weight_sum"),
        F.avg("weight").alias("weight_mean"), F.max("weight").alias("weight_max"), F.min("weight").alias("weight_min"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "symbol", "score", "weight")))).alias("top_5"),
    )
    return stats


def factor_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_samp(c).alias(f"{c}_std") for c in columns]
    )


# ---- event tables -----------------------------------------------------------------------


def sentiment_summary(news: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Counts by class, mean score and confidence per symbol, over confident rows."""
    sure = news.filter(F.col("confidence") >= min_confidence)
    return sure.groupBy("symbol").agg(
        F.count("*").alias("total_count"),
        *[F.count_if(F.col("sentiment") == s).alias(f"{s}_count") for s in ("positive", "negative", "neutral")],
        F.avg("sentiment_score").alias("avg_sentiment_score"), F.avg("confidence").alias("avg_confidence"),
    )


def flow_summary(flows: DataFrame) -> DataFrame:
    return flows.groupBy("symbol").agg(
        F.sum("net_amount").alias("total_net_amount"), F.sum("inflow_amount").alias("total_inflow"),
        F.sum("outflow_amount").alias("total_outflow"), F.avg("turnover_rate").alias("avg_turnover_rate"),
        F.count_if(F.col("direction") == "inflow").alias("inflow_days"),
        F.count_if(F.col("direction") == "outflow").alias("outflow_days"),
    )


def distinct_values(df: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    """Sorted distinct non-empty values per group; duplicates go before the group is gathered."""
    pairs = df.select(*by, F.nullif(column, F.lit("")).alias(column)).filter(F.col(column).isNotNull()).distinct()
    return pairs.groupBy(*by).agg(F.array_sort(F.collect_list(column)).alias(out))


def report_summary(reports: DataFrame) -> DataFrame:
    """Rating counts, mean target price and the institutions per symbol."""
    rating = F.col("rating")
    stats = reports.groupBy("symbol").agg(
        F.count("*").alias("total_count"), F.count_if(rating.isin("buy", "strong_buy")).alias("buy_count"),
        F.count_if(rating.isin("sell", "strong_sell")).alias("sell_count"),
        F.count_if(rating == "hold").alias("hold_count"),
        F.coalesce(F.avg("target_price"), F.lit(0.0)).alias("avg_target_price"),
    )
    names = distinct_values(reports, ["symbol"], "institution", "institutions")
    empty = F.array().cast("array<string>")
    return stats.join(names, "symbol", "left").withColumn("institutions", F.coalesce("institutions", empty))


def theme_summary(themes: DataFrame) -> DataFrame:
    """Counts by type, mean weight and the five heaviest themes per symbol."""
    kind = F.col("theme_type")
    stats = themes.groupBy("symbol").agg(
        F.count("*").alias("total_count"),
        *[F.count_if(kind == k).alias(f"{k}_count") for k in ("concept", "sector", "industry")],
        F.avg("weight").alias("avg_weight"),
    )
    order = [F.col("weight").desc(), F.col("theme_name"), F.col("theme_id")]
    top = top_k_list(themes, ["symbol"], order, 5, ["theme_name", "weight"], "top_themes")
    return stats.join(top, "symbol")


def top_trader_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol").agg(
        F.count("*").alias("total_count"), F.sum("buy_amount").alias("total_buy_amount"),
        F.sum("sell_amount").alias("total_sell_amount"), F.sum("net_amount").alias("total_net_amount"),
        F.avg("turnover_rate").alias("avg_turnover_rate"), F.avg("price_change").alias("avg_price_change"),
    )


# ---- reference tables -------------------------------------------------------------------


def index_concentration(members: DataFrame) -> DataFrame:
    """Weight sums, top-10 share and Herfindahl index per index."""
    w = F.col("weight")
    stats = members.groupBy("index_code").agg(
        F.count("*").alias("total_components"), F.sum(w).alias("total_weight"), F.sum(w * w).alias("hhi"),
        F.max(w).alias("max_weight"), F.min(w).alias("min_weight"), F.avg(w).alias("avg_weight"),
    )
    rn = F.row_number().over(Window.partitionBy("index_code").orderBy(w.desc(), "symbol"))
    ten = members.withColumn("_rn", rn).filter("_rn <= 10").groupBy("index_code").agg(F.sum(w).alias("top10_weight"))
    share = F.when(F.col("total_weight") > 0, F.col("top10_weight") / F.col("total_weight")).otherwise(0.0)
    return stats.join(ten, "index_code").withColumn("top10_concentration", share)


def industry_hierarchy(classes: DataFrame, levels=("level1", "level2", "level3", "level4")) -> DataFrame:
    """One column per level: the newest class name of the symbol."""
    newest = F.max_by("industry_name", F.struct("effective_date", "industry_code"))
    return classes.groupBy("symbol").pivot("industry_level", list(levels)).agg(newest)


def industry_stats(classes: DataFrame) -> DataFrame:
    """Counts by class and by level, and the most common class, as (kind, name, n) rows."""
    label = F.concat_ws("_", "industry_code", "industry_name")
    by_class = classes.groupBy(label.alias("name")).agg(F.count("*").alias("n"))
    by_level = classes.groupBy(F.col("industry_level").alias("name")).agg(F.count("*").alias("n"))
    best = by_class.agg(F.max_by("name", F.struct("n", "name")).alias("name"), F.max("n").alias("n"))
    return (
        by_class.select(F.lit("industry").alias("kind"), "name", "n")
        .union(by_level.select(F.lit("level"), "name", "n")).union(best.select(F.lit("most_common"), "name", "n"))
    )


def macro_trend(macro: DataFrame) -> DataFrame:
    """First, last, change, means of the last 12 and 6 points, deviation and direction per series."""
    order = Window.partitionBy("data_code").orderBy(F.col("date").desc())
    v = F.col("value")
    # One row per period and series: a series is as long as the calendar.
    ranked = macro.select("data_code", "date", "value", F.row_number().over(order).alias("_rn"))
    stats = ranked.groupBy("data_code").agg(
        F.count("*").alias("data_points"), F.min_by(v, "date").alias("first_value"),
        F.max_by(v, "date").alias("last_value"), F.avg(v).alias("average_value"),
        F.avg(F.when(F.col("_rn") <= 12, v)).alias("_ma12"), F.avg(F.when(F.col("_rn") <= 6, v)).alias("_ma6"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("volatility"), F.max(v).alias("max_value"),
        F.min(v).alias("min_value"),
    )
    short, change = F.col("data_points") < 12, F.col("last_value") - F.col("first_value")
    rate = F.coalesce(F.try_divide(change * 100, F.col("first_value")), F.lit(0.0))
    word = F.when(change > 0, fixed.TREND_UP).when(change < 0, fixed.TREND_DOWN).otherwise(fixed.TREND_FLAT)
    return stats.withColumns({
        "total_change": change, "total_change_rate": F.round(rate, 2),
        "ma12": F.round(F.when(short, F.col("average_value")).otherwise(F.col("_ma12")), 2),
        "ma6": F.round(F.when(short, F.col("average_value")).otherwise(F.col("_ma6")), 2),
        "volatility": F.round("volatility", 2), "trend": word,
    }).drop("_ma12", "_ma6")


def macro_corr(macro: DataFrame, codes: list[str], strong: float = 0.7) -> DataFrame:
    """Pearson coefficient of every pair of the named series on complete dates."""
    if len(codes) < 2:
        raise ValueError("at least two series are needed")
    from tapeloom.operators.joins import align_series

    wide = align_series(macro, codes)
    pairs = [(a, b) for i, a in enumerate(codes) for b in codes[i + 1:]]
    # Every coefficient comes from one pass over the aligned dates.
    stats = wide.agg(F.array(*[
        F.struct(F.lit(a).alias("series1"), F.lit(b).alias("series2"), F.corr(a, b).alias("correlation"))
        for a, b in pairs
    ]).alias("p"), F.count("*").alias("data_points"))
    out = stats.select("data_points", F.inline("p")).filter("data_points >= 2")
    c = F.col("correlation")
    word = F.when(c > 0, fixed.CORR_POSITIVE).otherwise(fixed.CORR_NEGATIVE)
    return out.withColumns({"is_strong": F.abs(c) >= strong, "strength": F.when(F.abs(c) >= strong, word)})
