"""Rolling and whole-history percentiles against brute force, and on series cut into blocks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.carry import in_blocks
from tapeloom.operators import series


@pytest.fixture(scope="module")
def valued(spark):
    rng = np.random.default_rng(2)
    rows = [("e", "hot" if i % 4 else "b", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), None if i % 13 == 0 else float(rng.integers(0, 40)))
            for i in range(1500)]
    return rows, spark.createDataFrame(rows, "exchange string, symbol string, date timestamp_ntz, pe_ratio double")


def rolling(rows, n):
    seen, out = {}, {}
    for _, symbol, date, x in rows:
        window = seen.setdefault(symbol, [])
        window.append(x)
        del window[:-n]
        above = 0 if x is None else sum(y is not None and y >= x for y in window)
        out[symbol, date] = 100.0 * above / len(window)
    return out


@pytest.mark.parametrize("n", [1, 7, 252])
def test_rolling_percentile(valued, n):
    rows, df = valued
    want = rolling(rows, n)
    plain = series.valuation_percentile(df, rows=n)
    blocks = in_blocks(df, ["exchange", "symbol"], ["date"], n - 1, lambda x, keys: series.valuation_percentile(x, rows=n, keys=keys), block_rows=100)
    for found in (plain, blocks):
        got = {(r["symbol"], r["date"]): r["pe_ratio_percentile"] for r in found.collect()}
        assert got.keys() == want.keys() and [got[k] for k in want] == pytest.approx(list(want.values()))
    assert "collect_list" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_nan_is_greatest(spark):
    df = spark.createDataFrame([("e", "a", i, x) for i, x in enumerate([float("nan"), 1.0, float("inf"), float("nan"), None])],
                               "exchange string, symbol string, date int, pe_ratio double")
    got = [r["pe_ratio_percentile"] for r in series.valuation_percentile(df).orderBy("date").collect()]
    assert got == pytest.approx([100.0, 100.0, 200 / 3, 50.0, 0.0])


def test_ranks_of_a_hot_series(spark, valued):
    rows, df = valued
    pdf = pd.DataFrame(rows, columns=["exchange", "symbol", "date", "x"])
    want = pdf.groupby("symbol")["x"].rank(pct=True) * 100
    got = {(r["symbol"], r["date"]): r["percentile"] for r in series.pct_rank_history(df).collect()}
    assert len(got) == len(rows)
    for (_, symbol, date, _x), p in zip(rows, want, strict=True):
        assert got[symbol, date] == (None if np.isnan(p) else pytest.approx(p))
    # One value in most rows is one row of the counts.
    flat = df.withColumn("pe_ratio", F.lit(5.0))
    assert {r["percentile"] for r in series.pct_rank_history(flat).filter("symbol = 'b'").collect()} == {100 * (375 + 1) / 2 / 375}
    assert series.average_ranks(flat, ["exchange", "symbol"], "pe_ratio").count() == 2
