"""Hand-made series: warm-up, gaps, ties, short histories, crossover modes."""

import math

import numpy as np
import pandas as pd
import pytest

from tapeloom.operators import joins, resample, series

RISE_FALL = list(np.linspace(10, 12, 30)) + list(np.linspace(12, 11, 30))


def column(df, name, order="datetime"):
    return [r[name] for r in df.orderBy(order).collect()]


def crossing(closes, fast, slow, mode="regime", band_bp=0.0, long_only=False, delay=0):
    """Plain pandas form of the signal, for comparison."""
    px = pd.Series(closes)
    f, s = px.rolling(fast).mean(), px.rolling(slow).mean()
    band = s.abs() * band_bp / 1e4
    sign = ((f - s) > band).astype(int) - ((f - s) < -band).astype(int)
    if mode == "regime":
        out = sign.replace(0, np.nan).ffill().fillna(0).astype(int)
    else:
        prev = sign.shift(1).fillna(0)
        out = ((prev <= 0) & (sign > 0)).astype(int) - ((prev >= 0) & (sign < 0)).astype(int)
    if long_only:
        out = out.clip(lower=0)
    out = out.shift(delay).fillna(0).astype(int) if delay else out
    if s.first_valid_index() is not None:
        out.iloc[: s.first_valid_index() + 1] = 0
    return out.tolist()


@pytest.mark.parametrize("kw", [
    {}, {"mode": "on_cross"}, {"band_bp": 3.0}, {"long_only": True}, {"delay": 1}, {"mode": "on_cross", "delay": 2, "band_bp": 3.0},
])
def test_crossover_modes(bars_of, kw):
    got = column(series.ma_cross(bars_of(a=RISE_FALL), 5, 10, **kw), "signal")
    assert got == crossing(RISE_FALL, 5, 10, **kw)


def test_crossover_rejects_bad_arguments(bars_of):
    with pytest.raises(ValueError):
        series.ma_cross(bars_of(a=[1.0]), 0, 5)
    with pytest.raises(ValueError):
        series.ma_cross(bars_of(a=[1.0]), 2, 5, mode="other")


@pytest.mark.parametrize("span,block", [(3, 4), (10, 64), (12, 5)])
def test_ema_equals_the_recursion(bars_of, span, block):
    closes = list(np.random.default_rng(1).uniform(5, 50, 200))
    got = column(series.ema(bars_of(a=closes), {"e": span}, block=block), "e")
    want = pd.Series(closes).ewm(span=span, adjust=False, min_periods=span).mean()
    for g, w in zip(got, want):
        assert (g is None and math.isnan(w)) or g == pytest.approx(w, rel=1e-12)


@pytest.mark.parametrize("n", [1, 20, 119, 120, 121])
def test_momentum_guards(bars_of, n):
    bars = bars_of(a=[float(i + 1) for i in range(n)])
    cfg, span = series.momentum_cfg(bars, 120).collect(), series.momentum_span(bars, 120).collect()
    assert len(cfg) == (1 if n >= 121 else 0)
    assert (span[0]["momentum"] is None) == (n < 120)


def test_returns_fill_gaps(bars_of):
    got = column(series.returns(bars_of(a=[10.0, None, 11.0, None, 12.1])), "ret")
    assert got[0] is None
    assert got[1:] == pytest.approx([0.0, 0.1, 0.0, 0.1])


def test_constant_series(bars_of):
    bars = bars_of(a=[5.0] * 30)
    assert column(series.volatility_n(bars, 20), "volatility")[-1] == 0.0
    assert column(series.valuation_percentile(bars.withColumnRenamed("datetime", "date"), "close", 10), "close_percentile", "date")[-1] == 100.0


def test_average_rank_percentile(bars_of):
    values = [3.0, 1.0, 3.0, 2.0, 5.0, 3.0]
    bars = bars_of(a=values).withColumnRenamed("datetime", "date")
    got = column(series.pct_rank_history(bars, "close"), "percentile", "date")
    assert got == pytest.approx((pd.Series(values).rank(pct=True) * 100).tolist())


def test_adjust_modes(spark, bars_of):
    bars = bars_of(a=[10.0, 10.0, 10.0, 10.0])
    rows = [("SSE", "a", r["datetime"], f) for r, f in zip(bars.orderBy("datetime").collect()[1:4:2], (2.0, 4.0))]
    factors = spark.createDataFrame(rows, "exchange string, symbol string, datetime timestamp_ntz, adj_factor double")
    assert column(joins.adjust_ratio(bars, factors, "qfq"), "close") == [None, 5.0, 5.0, 10.0]
    assert column(joins.adjust_ratio(bars, factors, "hfq"), "close") == [None, 20.0, 20.0, 10.0]
    assert column(joins.adjust_ratio(bars, factors, "hfq_first"), "close") == [None, 10.0, 10.0, 20.0]
    assert column(joins.apply_adjust(bars, factors), "close") == [None, 20.0, 20.0, 40.0]
    assert column(joins.apply_adjust(bars, factors, mode="asof"), "close") == [None, 20.0, 20.0, 40.0]


def test_resample_labels_and_nulls(spark):
    import datetime as dt

    times = [dt.datetime(2024, 1, 5, 9), dt.datetime(2024, 1, 7, 10), dt.datetime(2024, 1, 8), dt.datetime(2024, 2, 1)]
    rows = [("a", "SSE", "1m", t, float(i), float(i), float(i), float(i), None, None) for i, t in enumerate(times)]
    schema = (
        "symbol string, exchange string, interval string, datetime timestamp_ntz, open double, high double, low double, close double, "
        "volume double, turnover double"
    )
    bars = spark.createDataFrame(rows, schema)
    week = resample.resample(bars, "1w").orderBy("datetime").collect()
    assert [r["datetime"].strftime("%F") for r in week] == ["2024-01-07", "2024-01-14", "2024-02-04"]
    assert week[0]["open"] == 0.0 and week[0]["close"] == 1.0 and week[0]["volume"] is None
    month = resample.resample(bars, "1mo").orderBy("datetime").collect()
    assert [r["datetime"].strftime("%F") for r in month] == ["2024-01-01", "2024-02-01"]
    with pytest.raises(ValueError):
        resample.resample(bars, "30m")


def test_resample_in_two_steps(spark):
    from tapeloom.sources.adapters import Tables

    ticks = Tables(spark, "/root/testdata/sf0.001").ticks()
    direct = resample.resample(ticks, "1d")
    stepped = resample.resample(resample.resample(resample.resample(ticks, "1m"), "1h"), "1d")
    cols = ["symbol", "datetime", "open", "high", "low", "close", "volume"]
    assert sorted(map(tuple, direct.select(cols).collect())) == sorted(map(tuple, stepped.select(cols).collect()))


def test_empty_input_keeps_columns(bars_of):
    empty = bars_of(a=[1.0]).limit(0)
    for df in (series.flow_factors(empty), series.ma_cross(empty), resample.resample(empty, "1w"), series.momentum_span(empty)):
        assert df.count() == 0 and df.columns


def test_ema_of_span_one_is_the_price(spark, bars_of):
    falling = bars_of(a=[float(x) for x in range(20, 0, -1)])
    got = series.ema(falling, {"one": 1, "two": 2}).orderBy("datetime").collect()
    assert [r["one"] for r in got] == [r["close"] for r in got] and got[0]["two"] is None and abs(got[1]["two"] - (20 / 3 + 19 * 2 / 3)) < 1e-12
    assert {r["signal"] for r in series.ma_cross(falling, 1, 3, ma="ema").collect()} <= {0, -1}
    with pytest.raises(ValueError):
        series.ema(falling, {"none": 0})
