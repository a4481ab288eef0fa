"""Window operators over one bar series per (exchange, symbol, interval).

Bar keys are unique, so a daily series is bounded by the calendar. All columns of a call
share one window specification: one shuffle by series, whatever the number of columns.
Tick series go through ``functions.carry`` or are resampled first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from tapeloom.functions.quantiles import matched
from tapeloom.session import materialize

KEYS = ("exchange", "symbol", "interval")


def over_series(keys=KEYS, order: str = "datetime", descending: bool = False) -> WindowSpec:
    key = F.col(order).desc() if descending else F.col(order).asc()
    return Window.partitionBy(*keys).orderBy(key)


def filled(c: str, w: WindowSpec) -> Column:
    """The last known value up to the row."""
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def forward_fill(df: DataFrame, columns: list[str], keys=KEYS, order: str = "datetime") -> DataFrame:
    w = over_series(keys, order)
    return df.withColumns({c: filled(c, w) for c in columns})


def returns(df: DataFrame, price: str = "close", out: str = "ret", keys=KEYS, order: str = "datetime") -> DataFrame:
    """Change against the previous row, gaps filled first."""
    w = over_series(keys, order)
    known = df.withColumn("_known", filled(price, w))
    ratio = F.try_divide(F.col("_known"), F.lag("_known").over(w))
    return known.withColumn(out, ratio - 1).drop("_known")


def momentum_n(df: DataFrame, n: int = 120, out: str = "momentum", keys=KEYS, order: str = "datetime") -> DataFrame:
    """close against the close n rows back."""
    w = over_series(keys, order)
    known = df.withColumn("_known", filled("close", w))
    return known.withColumn(out, F.try_divide(F.col("_known"), F.lag("_known", n).over(w)) - 1).drop("_known")


def _newest_first(df: DataFrame, keys, order: str, rows: int) -> DataFrame:
    """The last ``rows`` rows per series, numbered from the newest (``_rn`` = 1)."""
    rn = F.row_number().over(over_series(keys, order, descending=True))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= rows)


def tail_per_symbol(df: DataFrame, n: int = 120, keys=KEYS, order: str = "datetime") -> DataFrame:
    return _newest_first(df, keys, order, n).drop("_rn")


def momentum_cfg(df: DataFrame, n: int = 120, keys=KEYS, order: str = "datetime") -> DataFrame:
    """Last close against the (n+1)-th close from the end; series of n rows or fewer drop out."""
    picked = _newest_first(df, keys, order, n + 1).groupBy(*keys).agg(
        F.max(F.when(F.col("_rn") == 1, F.col("close"))).alias("last_close"),
        F.max(F.when(F.col("_rn") == n + 1, F.col("close"))).alias("base_close"),
        F.max("_rn").alias("rows"),
    )
    return picked.filter(F.col("rows") == n + 1).select(
        *keys, (F.try_divide("last_close", "base_close") - 1).alias("momentum")
    )


def momentum_span(df: DataFrame, n: int = 120, keys=KEYS, order: str = "datetime") -> DataFrame:
    """Last against first close of the last n rows; null for a shorter series."""
    picked = _newest_first(df, keys, order, n).groupBy(*keys).agg(
        F.max(F.when(F.col("_rn") == 1, F.col("close"))).alias("last_close"),
        F.max(F.when(F.col("_rn") == n, F.col("close"))).alias("first_close"),
    )
    return picked.select(*keys, (F.try_divide("last_close", "first_close") - 1).alias("momentum"))


def volatility_n(df: DataFrame, n: int = 20, out: str = "volatility", keys=KEYS, order: str = "datetime") -> DataFrame:
    """Rolling sample deviation of the last n returns, null until n of them exist."""
    frame = over_series(keys, order).rowsBetween(-(n - 1), 0)
    rated = returns(df, out="_ret", keys=keys, order=order)
    full = F.count("_ret").over(frame) == n
    return rated.withColumn(out, F.when(full, F.stddev_samp("_ret").over(frame))).drop("_ret")


def volatility_last(df: DataFrame, n: int = 20, keys=KEYS, order: str = "datetime") -> DataFrame:
    """Sample deviation of the last n returns, or of those present; one row per series."""
    rated = returns(df, out="_ret", keys=keys, order=order)
    return _newest_first(rated, keys, order, n).groupBy(*keys).agg(F.stddev_samp("_ret").alias("volatility"))


def annualized_vol(df: DataFrame, days: int = 252, keys=KEYS, order: str = "datetime") -> DataFrame:
    rated = returns(df, out="_ret", keys=keys, order=order)
    return rated.groupBy(*keys).agg((F.stddev_samp("_ret") * F.sqrt(F.lit(float(days)))).alias("annualized_vol"))


def valuation_inverse(df: DataFrame, pe: str = "pe_ttm", out: str = "valuation") -> DataFrame:
    return df.withColumn(out, F.try_divide(F.lit(1.0), F.col(pe) + 1e-8))


def rolling_factors(
    df: DataFrame, momentum_rows: int = 120, volatility_rows: int = 20, keys=("symbol",), order: str = "trade_date"
) -> DataFrame:
    """On every row: span momentum over the last 120 rows and deviation of the last 20 returns."""
    w = over_series(keys, order)
    frame = w.rowsBetween(-(volatility_rows - 1), 0)
    rated = returns(df, out="_ret", keys=keys, order=order)
    seen = F.row_number().over(w) >= volatility_rows
    return rated.withColumns({
        "momentum_120": F.try_divide(F.col("close"), F.lag("close", momentum_rows - 1).over(w)) - 1,
        "volatility_20": F.when(seen, F.stddev_samp("_ret").over(frame)),
    }).drop("_ret")


# ---- moving averages and crossover ------------------------------------------------------


def sma(df: DataFrame, windows: dict[str, int], price: str = "close", keys=KEYS, order: str = "datetime") -> DataFrame:
    """Simple moving averages ``{out: rows}``, null until the window is full."""
    w = over_series(keys, order)

    def mean(rows: int) -> Column:
        frame = w.rowsBetween(-(rows - 1), 0)
        return F.when(F.count(price).over(frame) == rows, F.avg(price).over(frame))

    return df.withColumns({out: mean(rows) for out, rows in windows.items()})


def ema(
    df: DataFrame, windows: dict[str, int], price: str = "close", keys=KEYS, order: str = "datetime", block: int = 64,
) -> DataFrame:
    """Recursive means ``{out: span}``, seeded with the first value, null until span rows exist.

    The recursion is linear, so it splits into blocks of rows. Inside a block it is a
    weighted running sum; the value carried in from the blocks before is a short fold over
    one row per block; blocks more than 20 spans back weigh below e^-40 of a value, less than a
    double resolves, and are left out. Prices must not be null; a span of 1 is the price itself.
    """
    if min(windows.values()) < 1:
        raise ValueError("a span is at least 1")
    if any(span == 1 for span in windows.values()):
        rest = {name: span for name, span in windows.items() if span > 1}
        smoothed = ema(df, rest, price, keys, order, block) if rest else df
        return smoothed.withColumns({name: F.col(price).cast("double") for name, span in windows.items() if span == 1})
    w = over_series(keys, order)
    pos = F.row_number().over(w) - 1
    out = df.withColumn("_pos", pos).withColumn("_block", F.floor(F.col("_pos") / block))
    j = F.col("_pos") % block
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    decay = {name: 1 - 2.0 / (span + 1) for name, span in windows.items()}

    def local(q: float) -> Column:
        share = F.when(F.col("_pos") == 0, 1.0).otherwise(1 - q)
        return F.sum(F.col(price) * share * F.pow(F.lit(q), -j)).over(inside) * F.pow(F.lit(q), j)

    out = out.withColumns({f"_l_{name}": local(q) for name, q in decay.items()})
    tails = out.groupBy(*keys, "_block").agg(*[F.max_by(f"_l_{name}", "_pos").alias(f"_t_{name}") for name in decay])

    def carried(name: str, q: float) -> Column:
        reach = int(20 * windows[name] / block) + 2  # older blocks weigh less than a double can hold
        before = F.collect_list(f"_t_{name}").over(over_series(keys, "_block").rowsBetween(-reach, -1))
        return F.aggregate(before, F.lit(0.0), lambda acc, t: acc * F.lit(q**block) + t)

    tails = tails.select(*keys, "_block", *[carried(name, q).alias(f"_c_{name}") for name, q in decay.items()])
    joined = out.join(tails, [*keys, "_block"])
    means = [
        F.when(F.col("_pos") >= windows[name] - 1, F.col(f"_l_{name}") + F.col(f"_c_{name}") * F.pow(F.lit(q), j + 1))
        .alias(name)
        for name, q in decay.items()
    ]
    return joined.select(*df.columns, *means)


def ma_cross(
    df: DataFrame, fast: int = 10, slow: int = 30, ma: str = "sma", mode: str = "regime", band_bp: float = 0.0,
    long_only: bool = False, delay: int = 0, price: str = "close", keys=KEYS, order: str = "datetime",
) -> DataFrame:
    """Crossover signal in {-1, 0, 1} as column ``signal``.

    ``regime`` holds the last direction, ``on_cross`` pulses on the crossing row. Rows up to
    and including the first one with a full slow average are 0.
    """
    if fast <= 0 or slow <= 0:
        raise ValueError("fast and slow must be positive")
    if mode not in ("regime", "on_cross"):
        raise ValueError("mode must be 'regime' or 'on_cross'")
    average = {"sma": sma, "ema": ema}[ma.lower()]
    w = over_series(keys, order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = average(df, {"_fast": fast, "_slow": slow}, price, keys, order)
    gap = F.col("_fast") - F.col("_slow")
    band = F.greatest(F.abs("_slow"), F.lit(1e-12)) * (band_bp / 10000.0)
    out = out.withColumn("_sign", F.when(gap > band, 1).when(gap < -band, -1).otherwise(0))
    if mode == "regime":
        last = F.last(F.nullif("_sign", F.lit(0)), ignorenulls=True).over(upto)
        out = out.withColumn("_sig", F.coalesce(last, F.lit(0)))
    else:
        prev = F.coalesce(F.lag("_sign").over(w), F.lit(0))
        pulse = F.when((prev <= 0) & (F.col("_sign") > 0), 1).when((prev >= 0) & (F.col("_sign") < 0), -1)
        out = out.withColumn("_sig", pulse.otherwise(0))
    signal = F.greatest("_sig", F.lit(0)) if long_only else F.col("_sig")
    if delay > 0:
        signal = F.coalesce(F.lag(signal, delay).over(w), F.lit(0))
    mature = F.count("_slow").over(upto) > 1
    never = F.count("_slow").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == 0
    out = out.withColumn("signal", F.when(mature | never, signal).otherwise(0).cast("int"))
    return out.drop("_fast", "_slow", "_sign", "_sig")


# ---- flow factors -----------------------------------------------------------------------


def flow_factors(df: DataFrame, keys=KEYS, order: str = "datetime") -> DataFrame:
    """Net inflow with its 70/30 split, volume ratio, 5- and 20-row momentum, in one pass."""
    w = over_series(keys, order)
    rn = F.row_number().over(w)
    mean20 = F.avg("volume").over(w.rowsBetween(-20, -1))

    def momentum(rows: int) -> Column:
        base = F.lag("close", rows).over(w)
        return F.coalesce(F.try_divide(F.col("close") - base, base), F.lit(0.0))

    out = df.withColumns({
        "net_inflow": F.coalesce((F.col("close") - F.lag("close").over(w)) * F.col("volume") / 1e6, F.lit(0.0)),
        "volume_ratio": F.when((rn > 20) & (mean20 > 0), F.try_divide(F.col("volume"), mean20)).otherwise(1.0),
        "price_momentum_5d": momentum(5), "price_momentum_20d": momentum(20),
    })
    return flow_shares(out)


def flow_shares(df: DataFrame) -> DataFrame:
    """The 70/30 split of the net inflow and the product of volume ratio and momentum."""
    return df.withColumns({
        "main_inflow": F.col("net_inflow") * 0.7, "retail_inflow": F.col("net_inflow") * 0.3,
        "price_volume_ratio": F.col("volume_ratio") * F.col("price_momentum_5d"),
    })


# ---- statements and valuation -----------------------------------------------------------


def statement_growth(df: DataFrame, fields: list[str], keys=("exchange", "symbol", "report_type")) -> DataFrame:
    """Percent change of each field against the previous report."""
    w = over_series(keys, "report_date")
    return df.withColumns({f"{f}_growth": 100 * (F.try_divide(F.col(f), F.lag(f).over(w)) - 1) for f in fields})


def valuation_percentile(df: DataFrame, metric: str = "pe_ratio", rows: int = 252, keys=("exchange", "symbol"), order: str = "date") -> DataFrame:
    """Percent of the last ``rows`` rows whose metric is not below the current one; 0 where the current one is null.

    A series is compared in numpy by shifted slices, so no row carries a list. Series without a bound go through
    ``carry.in_blocks`` with a look back of rows - 1. NaN counts as the greatest value.
    """
    out = f"{metric}_percentile"
    given = df.drop(out)

    def rated(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        column = table.column(metric).cast(pa.float64())
        value, known = column.to_numpy(), ~column.is_null().to_numpy(zero_copy_only=False)
        code = np.where(known, np.unique(value, return_inverse=True)[1], -1)
        # NaN marks nulls in ``value`` too; they only take a code of their own, which is overwritten.
        above = (known & (code >= 0)).astype(np.int64)
        for back in range(1, min(rows, len(code))):
            above[back:] += code[:-back] >= code[back:]
        above[~known] = 0
        return table.append_column(out, pa.array(100.0 * above / np.minimum(np.arange(1, len(code) + 1), rows)))

    return given.groupBy(*keys).applyInArrow(rated, T.StructType([*given.schema.fields, T.StructField(out, T.DoubleType())]))


def pct_rank_history(
    df: DataFrame, metric: str = "pe_ratio", keys=("exchange", "symbol"), cheap: float = 30, dear: float = 70
) -> DataFrame:
    """Average-rank percentile over the whole history, with a cheap / fair / dear level; see ``average_ranks``."""
    ranks = average_ranks(df, list(keys), metric)
    pct = F.when(F.col(metric).isNotNull(), F.try_divide(F.col("_rank") * 100, F.col("_total")))
    out = matched(df, ranks, [*keys, metric], "left").withColumn("percentile", pct).drop("_rank", "_total")
    level = F.when(F.col("percentile") < cheap, "cheap").when(F.col("percentile") > dear, "dear").otherwise("fair")
    return out.withColumn("level", F.when(F.col("percentile").isNotNull(), level))


def average_ranks(df: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """(keys, metric, _rank, _total): the average rank of every distinct value in its series, and the rows of the series.

    No series is sorted in one task: values are counted first, the counts are dealt by range of (series, value), a window sums
    them inside a range, and what lies in earlier ranges of a series comes from a table of one row per series and range.
    """
    counts = df.filter(F.col(metric).isNotNull()).groupBy(*keys, metric).agg(F.count("*").alias("_c"))
    ranged = materialize(counts.repartitionByRange(*keys, metric).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("_c").alias("_sum"))
    series = Window.partitionBy(*keys)
    before = F.sum("_sum").over(series.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*keys, "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_sum").over(series).alias("_total"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_range").orderBy(metric))
    placed = matched(ranged.withColumn("_upto", upto), offsets, [*keys, "_range"])
    # Of c equal values the first has rank before + upto - c + 1, the mean lies (c - 1) / 2 after it.
    rank = F.col("_before") + F.col("_upto") - F.col("_c") + 1 + (F.col("_c") - 1) / 2
    return placed.select(*keys, metric, rank.alias("_rank"), "_total")


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row per key, by a combinable aggregate."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return newest.select(*keys, "_r.*")


def last_n_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str | None = None) -> DataFrame:
    """First n rows per key in ``order``; the window limit prunes before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    numbered = df.withColumn(out or "_rn", rn).filter(F.col(out or "_rn") <= n)
    return numbered if out else numbered.drop("_rn")


def annual_reports(df: DataFrame, years: int) -> DataFrame:
    yearly = df.filter(F.col("report_period").isin("annual", "q4"))
    return last_n_rows(yearly, ["exchange", "symbol"], [F.col("report_date").desc()], years)


def data_age(df: DataFrame, now, keys=("symbol",), order: str = "datetime", open_s: int = 300, stale_s: int = 60) -> DataFrame:
    """Seconds since the newest row; open below ``open_s``, refresh due from ``stale_s`` on."""
    age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("last_time").cast("timestamp"))
    latest = df.groupBy(*keys).agg(F.max(order).alias("last_time")).withColumn("age_seconds", age)
    return latest.withColumns({
        "is_open": F.col("age_seconds") < open_s, "needs_refresh": F.col("age_seconds") >= stale_s,
    })
