"""Steps whose cost must not outgrow the input: where rows are shuffled, how many tasks share them."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tapeloom.operators import joins, layers, lineage
from tapeloom.operators.series import KEYS
from tapeloom.plans import lake
from tapeloom.session import tasks_for
from tapeloom.sinks import tables as sinks
from tapeloom.sources import adapters
from tapeloom.sources.adapters import Tables


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_intervals_without_keys_are_dealt_over_many_tasks(spark):
    day = dt.date(2024, 1, 1)
    dates = spark.createDataFrame([(day + dt.timedelta(days=i),) for i in range(50)], "d date")
    rows = [(i, day + dt.timedelta(days=i % 40), None if i % 3 else day + dt.timedelta(days=i % 40 + 9)) for i in range(200)]
    out = joins.valid_on(dates, spark.createDataFrame(rows, "i int, effective_date date, end_date date"), [], "d")
    got = sorted((r["d"], r["i"]) for r in out.collect())
    assert got == sorted((day + dt.timedelta(days=k), i) for k in range(50) for i, a, b in rows if a <= day + dt.timedelta(days=k) and (b is None or b > day + dt.timedelta(days=k)))
    assert out.rdd.getNumPartitions() >= 32


def test_a_load_of_events_is_written_where_it_lies(spark):
    path = sinks.scratch_path(spark, "load")
    rows = spark.range(90).select(F.col("id").cast("string").alias("symbol"), F.col("id").alias("date"), "id").repartition(3)
    sinks.write_events(rows, path, "2024-12-01", "date")
    assert len([f for f in os.listdir(f"{path}/load_date=2024-12-01") if f.endswith(".parquet")]) == 3
    sinks.write_events(rows.filter("id < 5"), path, "2024-12-02", "date")
    latest = sinks.read_latest_load(spark, path, ["id"], [])
    assert latest.columns == ["id", "load_date"]
    assert latest.count() == 90 and latest.filter("load_date = date'2024-12-02'").count() == 5


def test_factors_of_every_40th_bar_take_one_shuffle(spark, tmp_path):
    days = [dt.datetime(1997, 1, 1) + dt.timedelta(days=i * 7 % 100) for i in range(300)]
    pq.write_table(pa.table({"l_suppkey": [i // 100 for i in range(300)], "l_shipdate": days}), f"{tmp_path}/lineitem.parquet", coerce_timestamps="us")
    found = Tables(spark, str(tmp_path)).adj_factor()
    assert exchanges(found) == 1
    at = {k: dt.datetime(1997, 1, 1) + dt.timedelta(days=40 * k - 1) for k in (1, 2)}
    assert sorted(map(tuple, found.collect())) == sorted(
        ("SSE" if s % 2 == 0 else "SZSE", str(s), at[k], 1 + 0.01 * k) for s in range(3) for k in (1, 2))


def test_adjusting_whole_series_shuffles_the_bars_once(spark, bars_of):
    dwd = layers.dwd_bars(bars_of(a=[float(i + 1) for i in range(60)], b=[2.0] * 50))
    factors = dwd.filter("day(datetime) = 9").select("exchange", "symbol", "datetime", F.month("datetime").cast("double").alias("adj_factor"))
    want = sorted(map(str, layers.dws_adjusted(dwd, factors, "2024-01-01").collect()))
    with sinks.without_reshuffle(spark):
        rated = layers.rated_by_series(dwd.hint("merge"), factors)
        assert exchanges(rated) == 2
        got = sorted(map(str, layers.adjusted_by(rated, "2024-01-01").collect()))
    assert got == want and len(got) == 110


def shuffled_rows(spark, since=-1):
    """(newest stage, rows that the stages after ``since`` wrote to shuffles)"""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    seen = [(stages.apply(i).stageId(), stages.apply(i).shuffleWriteRecords()) for i in range(stages.size())]
    return max((i for i, _ in seen), default=-1), sum(n for i, n in seen if i > since)


def line_items(folder, symbols=6, days=400):
    start = dt.datetime(1997, 1, 1)
    rows = [(s, d, i) for s in range(symbols) for d in range(days) for i in range(2 if d % 5 == 0 else 1)]
    pq.write_table(pa.table({
        "l_orderkey": [(d * 7 + s) % 90 for s, d, _ in rows], "l_linenumber": pa.array([2 - i for _, _, i in rows], pa.int32()),
        "l_partkey": [s + d for s, d, _ in rows], "l_suppkey": [s for s, _, _ in rows], "l_quantity": [float(1 + (d + i) % 7) for _, d, i in rows],
        "l_extendedprice": [100.0 + s * d % 31 + i for s, d, i in rows], "l_shipdate": [start + dt.timedelta(days=d) for _, d, _ in rows],
        "l_discount": [0.0] * len(rows), "l_tax": [0.0] * len(rows),
    }), f"{folder}/lineitem.parquet", coerce_timestamps="us")
    return len(rows), symbols * days


def test_a_run_of_the_bar_layers_moves_a_bar_twice(spark, tmp_path):
    items, bars = line_items(tmp_path)
    last, _ = shuffled_rows(spark)
    counts = contract.queries()["bar_layers_pipeline"](spark, str(tmp_path)).collect()
    assert {r["n"] for r in counts} == {bars}
    # Line items to their series, bars to their month; the days and factors of a series are few rows.
    assert shuffled_rows(spark, last)[1] < items + bars * 1.2


def test_the_derived_tables_take_two_shuffles_of_the_bars_together(spark, tmp_path):
    items, bars = line_items(tmp_path)
    queries = contract.queries()
    last, _ = shuffled_rows(spark)
    merged = len(queries["dws_merged_financial"](spark, str(tmp_path)).collect())
    last, of_merged = shuffled_rows(spark, last)
    found = queries["write_dws"](spark, str(tmp_path))
    _, shuffled = shuffled_rows(spark, last)
    assert found.count() == 2 * bars + merged
    # Besides the merged statements: line items to their series, bars to their month.
    assert shuffled - of_merged < items + bars * 1.4


def test_bars_by_series_are_the_same_bars(spark, tmp_path, monkeypatch):
    line_items(tmp_path)
    tables = Tables(spark, str(tmp_path))
    want = sorted(map(str, tables.bars().collect()))
    dealt = tables.bars(5)
    assert exchanges(dealt) == 1 and dealt.columns == tables.bars().columns
    assert sorted(map(str, dealt.collect())) == want
    monkeypatch.setattr(adapters, "DEALT_ROWS", 100)  # a symbol of more items: bars are made first
    summed = tables.bars(5)
    assert exchanges(summed) == 2 and sorted(map(str, summed.collect())) == want
    assert tables.series_tasks() == 8 and tables.series_tasks(100) == 29


def test_layers_keep_own_columns_and_one_row_per_bar(spark, bars_of, tmp_path):
    named = bars_of(a=[float(i + 1) for i in range(60)], b=[2.0] * 50).withColumns(
        {"ratio": F.lit("mine"), "adj_factor": F.lit(7.0), "net_inflow": F.col("close") * 2, "year": F.lit("of the vendor")})
    marks = spark.createDataFrame([("SSE", "a", dt.datetime(2024, 1, d), f) for d, f in ((5, 1.0), (20, 2.0), (20, 1.5))], "exchange string, symbol string, datetime timestamp_ntz, adj_factor double")
    path = str(tmp_path)
    assert {r["n"] for r in lake.run_bar_layers(named, "x", path, marks).collect()} == {110}
    ods, adjusted = (sinks.read_table(spark, f"{path}/{name}") for name in ("ods_bars", "dws_adjusted"))
    assert sorted(map(tuple, ods.select("ratio", "adj_factor", "net_inflow", "close").distinct().collect())) == sorted(
        ("mine", 7.0, 2 * c, c) for c in map(float, range(1, 61)))
    # Of two factors of a day the greatest counts; it is also the last one of the series.
    assert {r["datetime"].day: r["qfq_factor"] for r in adjusted.filter("symbol = 'a' and month = 1").collect()} == {
        d: 1.0 if d < 5 else 0.5 if d < 20 else 1.0 for d in range(1, 32)}


def test_only_months_near_a_change_are_read_for_its_reach(spark, bars_of):
    dwd = sinks.with_period(layers.dwd_bars(bars_of(a=[1.0] * 360, b=[2.0 if i % 9 == 0 else None for i in range(360)])).filter("close is not null"), "datetime")
    january = 2024 * 12
    changed = dwd.filter("symbol = 'a' and month = 1 and day(datetime) = 31").select(*KEYS, "datetime", "year", "month")
    assert lake._months_after(dwd, changed, january) == january + 2
    assert lake._reached(dwd, changed, january) == [january, january + 1]
    sparse = dwd.filter("symbol = 'b' and month = 1")
    # A bar every nine days: twenty of them take half a year.
    assert lake._months_after(dwd, sparse, january) == january + 8
    assert lake._reached(dwd, sparse, january) == list(range(january, january + 7))


def test_lineage_tasks_grow_with_the_edges(spark, monkeypatch):
    name = "spark.sql.shuffle.partitions"
    before, seen = spark.conf.get(name), []
    numbered = lineage.numbered
    monkeypatch.setattr(lineage, "tasks_for", lambda session, rows: tasks_for(session, rows, 10))
    monkeypatch.setattr(lineage, "numbered", lambda items: seen.append(int(spark.conf.get(name))) or numbered(items))
    edges = spark.createDataFrame([(f"a{i // 10}", f"b{i}") for i in range(100)] + [("r", f"a{i}") for i in range(10)], "source_id string, target_id string")
    nodes = spark.createDataFrame([(f"d{i % 3}", f"b{i}", "store") for i in range(100)], "dataset_id string, node_id string, node_type string")
    found = {r["node_id"]: r["total_impact"] for r in lineage.impact(edges).collect()}
    assert found["r"] == 110 and found["a3"] == 10 and found["b5"] == 0
    assert {r["dataset_id"] for r in lineage.dataset_impact(nodes, edges).collect()} == {"d0", "d1", "d2"}
    assert seen == [11, 21] and spark.conf.get(name) == before
