"""Bucketed tables, kept columns, pruned purges: results and plans."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import series
from tapeloom.sinks import tables as sinks

SETTING = "spark.sql.requireAllClusterKeysForCoPartition"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("symbols", [3, 40])
def test_join_and_window_over_buckets_need_no_shuffle(spark, symbols):
    rows = [(f"s{i % symbols}", dt.date(2024, 1, 1) + dt.timedelta(days=i // symbols), float(i)) for i in range(400)]
    prices = spark.createDataFrame(rows, "symbol string, trade_date date, close double")
    fund = prices.filter("dayofmonth(trade_date) % 3 <> 0").select("symbol", "trade_date", (F.col("close") * 2).alias("pe_ttm"))
    a, b = (sinks.write_bucketed(df, name, ["symbol"], ["trade_date"], 4) for df, name in ((prices, "prices"), (fund, "fund")))
    before = spark.conf.get(SETTING)
    with sinks.without_reshuffle(spark):
        out = series.returns(a.hint("merge").join(b, ["symbol", "trade_date"]), keys=("symbol",), order="trade_date")
        plan = executed(out)
        got = sorted(map(tuple, out.collect()))
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert spark.conf.get(SETTING) == before
    assert got == sorted(map(tuple, series.returns(prices.join(fund, ["symbol", "trade_date"]), keys=("symbol",), order="trade_date").collect()))
    assert "Exchange" not in executed(a.groupBy("symbol").agg(F.max("close")))


def test_columns_of_a_merged_table_are_kept_beside_it(spark):
    path = sinks.scratch_path(spark, "merged")
    make = lambda text, schema: spark.createDataFrame(text, schema)
    sinks.upsert_table(spark, path, make([("a", 1, 1.0, 0)], "p string, k int, x double, seq int"), ["p", "k"], ["p"], ["seq"])
    assert not os.path.exists(f"{path}/_schema")
    sinks.upsert_table(spark, path, make([("b", 1, 2.0, 7, 0)], "p string, k int, x double, y int, seq int"), ["p", "k"], ["p"], ["seq"])
    assert os.path.exists(f"{path}/_schema")
    # A plain write that adds a column is remembered too, and a folder with a broken footer elsewhere is not opened.
    sinks.write_table(make([("c", 1, 3.0, "z")], "p string, k int, x double, w string"), path, ["p"])
    table = sinks.read_table(spark, path, evolved=True)
    assert {r["k"]: None for r in table.collect()} and sorted((r["p"], r["k"], r["x"], r["y"], r["w"]) for r in table.collect()) == [
        ("a", 1, 1.0, None, None), ("b", 1, 2.0, 7, None), ("c", 1, 3.0, None, "z")]
    os.mkdir(f"{path}/p=d")
    with open(f"{path}/p=d/part-0.parquet", "w") as broken:
        broken.write("not parquet")
    sinks.upsert_table(spark, path, make([("a", 1, 9.0, 1)], "p string, k int, x double, seq int"), ["p", "k"], ["p"], ["seq"])
    assert [r["x"] for r in sinks.read_table(spark, path, evolved=True).filter("p = 'a'").collect()] == [9.0]


def test_purge_reads_only_old_folders(spark, bars_of):
    path = sinks.scratch_path(spark, "purge")
    sinks.write_table(sinks.with_period(bars_of(a=[float(i) for i in range(150)]), "datetime"), path, ["year", "month"])
    for name in os.listdir(f"{path}/year=2024/month=5"):
        if name.endswith(".parquet"):
            with open(f"{path}/year=2024/month=5/{name}", "r+b") as file:  # unreadable from here on
                file.truncate(10)
            crc = f"{path}/year=2024/month=5/.{name}.crc"
            os.path.exists(crc) and os.truncate(crc, 0)
    sinks.purge_table(spark, path, "2024-04-20", 60, "datetime", ["year", "month"])
    days = sorted(r["datetime"] for r in sinks.read_table(spark, path).filter("month < 5").collect())
    assert days[0] == dt.datetime(2024, 2, 20) and len(days) == 71
