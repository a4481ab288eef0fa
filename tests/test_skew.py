"""Hot keys: the split forms equal the plain ones."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.carry import with_previous
from tapeloom.functions.quantiles import exact_quantiles
from tapeloom.operators import crosssection as xs
from tapeloom.operators import quality
from tapeloom.operators.normalize import dedup_keep_last
from tapeloom.operators.upsert import upsert


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 rows, two thirds of them under one key, with ties, nulls and constants."""
    rng = np.random.default_rng(7)
    key = np.where(rng.random(3000) < 0.66, "hot", rng.choice(list("abcdef"), 3000))
    pdf = pd.DataFrame({"k": key, "x": rng.normal(size=3000), "y": rng.integers(0, 5, 3000).astype(float), "z": 1.0})
    pdf.loc[rng.choice(3000, 100), "x"] = np.nan
    sdf = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return pdf, sdf


@pytest.mark.parametrize("direct_rows,accuracy", [(10**6, 10_000), (0, 10_000), (100, 50), (0, 10)])
def test_quantiles_both_ways(hot, direct_rows, accuracy):
    pdf, sdf = hot
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    rows = exact_quantiles(sdf, ["k"], ["x", "y", "z"], probs, accuracy, direct_rows).collect()
    assert len(rows) == 7 * 3
    for r in rows:
        want = pdf[pdf.k == r["k"]][r["name"]].quantile(probs).tolist()
        assert [r[f"q{i}"] for i in range(6)] == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_quantiles_of_a_whole_table(hot):
    pdf, sdf = hot
    for direct_rows in (0, 10**6):
        row = exact_quantiles(sdf, [], ["x"], [0.25, 0.75], 100, direct_rows).first()
        assert [row["q0"], row["q1"]] == pytest.approx(pdf["x"].quantile([0.25, 0.75]).tolist())


def test_previous_row_over_chunks(spark):
    rng = np.random.default_rng(3)
    start = dt.datetime(2024, 1, 1)
    rows = [
        ("hot" if i % 3 else "b", start + dt.timedelta(seconds=int(rng.integers(0, 50_000))), i, float(i) if i % 4 else None)
        for i in range(2000)
    ]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id bigint, v double")
    got = {r["id"]: r["prev_v"] for r in with_previous(df, ["k"], ["ts", "id"], ["v"], "7 minutes").collect()}
    pdf = pd.DataFrame(rows, columns=["k", "ts", "id", "v"]).sort_values(["k", "ts", "id"])
    pdf["p"] = pdf.groupby("k")["v"].shift(1)
    assert len(got) == 2000
    for _, r in pdf.iterrows():
        assert got[r["id"]] == (None if pd.isna(r["p"]) else r["p"])


def least_squares(y, x, groups):
    dummies = pd.get_dummies(groups.fillna("none")).to_numpy(float)
    design = np.column_stack([dummies, np.nan_to_num(np.log(x + 1e-8)), np.ones(len(y))])
    return y - design @ np.linalg.lstsq(design, y, rcond=None)[0]


def test_neutralize_is_least_squares(spark):
    rng = np.random.default_rng(5)
    n = 200
    pdf = pd.DataFrame({
        "d": ["one"] * 150 + ["two"] * 50, "symbol": [str(i) for i in range(n)], "industry": rng.choice(["a", "b", "c", None], n),
        "mkt_cap": rng.uniform(1e8, 1e11, n), "f": rng.normal(size=n),
    })
    pdf.loc[::17, "mkt_cap"] = np.nan
    sdf = spark.createDataFrame(pdf).withColumn("mkt_cap", F.when(~F.isnan("mkt_cap"), F.col("mkt_cap")))
    got = {r["symbol"]: r["f"] for r in xs.neutralize(sdf, ["d"], ["f"]).collect()}
    for _, part in pdf.groupby("d"):
        want = least_squares(part.f.to_numpy(), part.mkt_cap.to_numpy(), part.industry)
        assert [got[s] for s in part.symbol] == pytest.approx(want.tolist(), abs=1e-9)


def test_neutralize_leaves_a_date_with_a_missing_score(spark):
    df = spark.createDataFrame([("d", "a", "i", 1e9, 1.0), ("d", "b", "i", 2e9, None)], "d string, symbol string, industry string, mkt_cap double, f double")
    assert [r["f"] for r in xs.neutralize(df, ["d"], ["f"]).orderBy("symbol").collect()] == [1.0, None]


def test_small_selection_exceeds_the_cap(spark):
    df = spark.createDataFrame([("d", str(i), 0.0) for i in range(10)], "trade_date string, symbol string, score double")
    got = xs.softmax_weight(xs.top_n(df, ["trade_date"], 10), ["trade_date"]).collect()
    assert [r["weight"] for r in got] == pytest.approx([0.1] * 10)


def test_zscore_of_constants_and_single_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0)], "d string, x double")
    assert [r["x"] for r in xs.zscore(df, ["d"], ["x"]).collect()] == [None] * 3


def test_dedup_and_upsert_with_copies(spark):
    rows = [("hot", 1, i) for i in range(500)] + [("b", 1, 3), ("b", 2, 1)]
    df = spark.createDataFrame(rows, "k string, t int, seq int")
    assert sorted(map(tuple, dedup_keep_last(df, ["k", "t"], ["seq"]).collect())) == [("b", 1, 3), ("b", 2, 1), ("hot", 1, 499)]
    old = spark.createDataFrame([("a", 1, 10), ("b", 1, 20)], "k string, t int, seq int")
    once = upsert(old, df, ["k", "t"], ["seq"])
    twice = upsert(once, df, ["k", "t"], ["seq"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 1, 10), ("b", 1, 3), ("b", 2, 1), ("hot", 1, 499)]


def test_outliers_of_a_hot_series_without_a_gathered_group(hot):
    _, sdf = hot
    plain, split = (quality.iqr_outliers(sdf, ["k"], ["x", "y", "z"], bounded=b) for b in (True, False))
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect())) and plain.count() > 0
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (plain, split)]
    assert "percentile(" in plans[0] and "percentile(" not in plans[1]
