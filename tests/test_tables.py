"""Sinks, streams in several batches, lineage on a cycle, quality on bad rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import layers, lineage, metrics, profile, quality, resample, retention
from tapeloom.operators.upsert import BAR_KEY
from tapeloom.plans import pipelines
from tapeloom.sinks import tables as sinks
from tapeloom.sources import scans
from tapeloom.sources.adapters import Tables
from tapeloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_partition_text_survives(spark, bars_of):
    path = sinks.scratch_path(spark, "t")
    sinks.write_bars(bars_of(a=[1.0, 2.0]), path)
    back = sinks.read_table(spark, path)
    assert {r["interval"] for r in back.collect()} == {"1d"}
    late = sinks.with_period(bars_of(a=[5.0]), "datetime")
    sinks.upsert_table(spark, path, late, BAR_KEY, ["exchange", "interval", "year", "month"], ["datetime"])
    assert sorted(r["close"] for r in sinks.read_table(spark, path).collect()) == [2.0, 5.0]


def test_purge_removes_whole_and_partial_partitions(spark, bars_of):
    path = sinks.scratch_path(spark, "purge")
    bars = bars_of(a=[float(i) for i in range(70)])
    sinks.write_table(sinks.with_period(bars, "datetime"), path, ["year", "month"])
    sinks.purge_table(spark, path, "2024-03-10", 20, "datetime", ["year", "month"])
    days = sorted(r["datetime"] for r in sinks.read_table(spark, path).collect())
    assert days[0] == dt.datetime(2024, 2, 19) and days[-1] == dt.datetime(2024, 3, 10) and len(days) == 21


def split_stream(spark, n):
    """The event table in n files by time, as a stream of one file per batch."""
    path = sinks.scratch_path(spark, "events")
    events = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(n):
        events.filter((F.dayofmonth("ts") - 1) * n >= 30 * i).filter((F.dayofmonth("ts") - 1) * n < 30 * (i + 1)).coalesce(1).write.mode("append").parquet(path)

    class Arriving(Tables):
        def raw(self, name):
            return jobs.file_stream(spark, path, events.schema, max_files=1) if name == "events" else super().raw(name)

    return Arriving(spark, SF)


def test_alerts_do_not_depend_on_batches(spark):
    rules = metrics.rule_table(spark)
    path = sinks.scratch_path(spark, "alerts")
    jobs.alert_batches(split_stream(spark, 5).metrics(), rules, path, path + "-checkpoint")
    got = spark.read.parquet(f"{path}/changes").select("rule", "event_id", "change")
    want = metrics.transitions(Tables(spark, SF).metrics(), rules).select("rule", "event_id", "change")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_latest_over_batches(spark):
    path = sinks.scratch_path(spark, "latest")
    jobs.upsert_latest(split_stream(spark, 3).ticks(), path, path + "-checkpoint")
    last = sinks.read_table(spark, path)
    want = Tables(spark, SF).ticks().groupBy("symbol").agg(F.max("datetime").alias("datetime"))
    assert sorted(map(tuple, last.select("symbol", "datetime").collect())) == sorted(map(tuple, want.collect()))


def test_stream_upsert_repeats_safely(spark):
    path = sinks.scratch_path(spark, "minutes")
    ticks = Tables(spark, SF).ticks().withColumn("day", F.dayofmonth("datetime"))
    sinks.write_table(ticks.filter("day <= 3"), path, ["exchange", "day"])
    for run in ("one", "two"):  # a second run with a fresh checkpoint merges the same rows again
        stream = split_stream(spark, 3).ticks().withColumn("day", F.dayofmonth("datetime")).withColumn("seq", F.lit(1))
        jobs.upsert_batches(stream, path, f"{path}-{run}", ["exchange", "day"])
    assert sinks.read_table(spark, path).count() == ticks.count()


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source_id string, target_id string")
    reach = lineage.closure(edges)
    assert sorted(map(tuple, reach.collect())) == [
        ("a", "b"), ("a", "c"), ("a", "d"), ("b", "a"), ("b", "c"), ("b", "d"), ("c", "a"), ("c", "b"), ("c", "d"),
    ]
    nodes = spark.createDataFrame([("a",), ("d",)], "node_id string")
    found = lineage.paths(edges, nodes.filter("node_id = 'a'"), nodes.filter("node_id = 'd'")).collect()
    assert [r["path"] for r in found] == [["a", "b", "c", "d"]]
    counts = {r["node_id"]: r for r in lineage.impact(edges).collect()}
    assert counts["c"]["direct_impact"] == 2 and counts["d"]["total_dependencies"] == 3


def test_closure_and_paths_of_long_chains(spark):
    chain = spark.range(400).selectExpr("concat('n', id) as source_id", "concat('n', id + 1) as target_id")
    assert lineage.closure(chain).count() == 400 * 401 // 2
    short = chain.filter("int(substring(source_id, 2)) < 14")
    ends = spark.createDataFrame([("n0",), ("n14",)], "node_id string")
    assert [len(r["path"]) for r in lineage.paths(short, ends.filter("node_id = 'n0'"), ends.filter("node_id = 'n14'")).collect()] == [15]
    down = lineage.closure(short, spark.createDataFrame([("n10",)], "node_id string"))
    assert sorted(r["node"] for r in down.collect()) == ["n11", "n12", "n13", "n14"] and {r["root"] for r in down.collect()} == {"n10"}


def test_profile_has_every_column(spark):
    df = spark.sql("select * from values (1, true, array('a'), map('k', 1)), (2, null, array('a'), null) t(n, flag, tags, m)")
    got = {r["column"]: r for r in profile.profile_table(df).collect()}
    assert set(got) == {"n", "flag", "tags", "m"} and got["flag"]["nulls"] == 1 and got["tags"]["distinct"] == 1


def test_table_is_created_merged_and_pruned(spark):
    path = sinks.scratch_path(spark, "lake")
    first = spark.sql("select * from values ('000001', 2020, 1, 1.0, 0), ('000001', 2020, 1, 2.0, 1), ('000002', 2021, 5, 3.0, 0) t(symbol, year, k, v, seq)")
    keys, parts = ["symbol", "year", "k"], ["symbol", "year"]
    sinks.upsert_table(spark, path, first, keys, parts, ["seq"])
    more = spark.sql("select * from values ('000001', 2020, 1, 9.0, 2, 'x'), ('000001', 2020, 2, 8.0, 2, 'y') t(symbol, year, k, v, seq, note)")
    sinks.upsert_table(spark, path, more, keys, parts, ["seq"])
    got = sinks.read_table(spark, path, evolved=True).orderBy("symbol", "k").collect()
    assert [(r["symbol"], r["year"], r["k"], r["v"], r["note"]) for r in got] == [
        ("000001", 2020, 1, 9.0, "x"), ("000001", 2020, 2, 8.0, "y"), ("000002", 2021, 5, 3.0, None)]
    pruned = sinks.only_partitions(sinks.read_table(spark, path), more, parts)
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2020" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_stored_layer_is_pruned_to_its_range(spark, bars_of):
    path = sinks.scratch_path(spark, "layer")
    sinks.write_bars(bars_of(a=[float(i) for i in range(100)]), path)
    part = scans.scan_layer(sinks.read_table(spark, path), "2024-02-10", "2024-02-20")
    filters = part._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert part.count() == 11 and "year" in filters and "month" in filters


def test_purge_of_escaped_and_null_partitions(spark):
    path = sinks.scratch_path(spark, "escaped")
    rows = spark.sql("select * from values ('a:b', date'2020-01-01'), ('c=d', date'2024-01-01'), (null, date'2020-01-01'), ('e', date'2020-01-01'), "
                     "('e', date'2024-01-01') t(name, day_of)")
    sinks.write_table(rows, path, ["name"])
    sinks.purge_table(spark, path, "2024-02-01", 100, "day_of", ["name"])
    assert sorted(r["name"] for r in sinks.read_table(spark, path).collect()) == ["c=d", "e"]


def test_null_keys_are_judged(spark):
    bars = bad_bars(spark).withColumn("exchange", F.lit(None).cast("string"))
    issues = quality.validate(bars)
    assert {"time_consistency", "missing_values"} <= {r["rule_name"] for r in issues.collect()}
    row = quality.metrics(issues, bars).first()
    assert row["overall_score"] < 1 and row["completeness"] == pytest.approx(0.8)


def test_open_buckets_complete_a_stream(spark):
    path = sinks.scratch_path(spark, "resampled")
    jobs.run_available(jobs.resample_stream(split_stream(spark, 3).ticks(), "1h"), path, path + "-checkpoint")
    done, ticks = spark.read.parquet(path), Tables(spark, SF).ticks()
    got = done.unionByName(jobs.open_buckets(ticks, done, "1h")).select("symbol", "datetime")
    want = resample.resample(ticks, "1h").select("symbol", "datetime")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_three_bars_lineage_and_layers(spark, bars_of):
    datasets = spark.createDataFrame([("000001", "akshare")], "symbol string, provider string")
    edges = lineage.chain_edges(datasets)
    assert edges.count() == 3 and edges.select("source_id").union(edges.select("target_id")).distinct().count() == 4
    frames, watch = pipelines.observed(pipelines.bar_layers(bars_of(a=[1.0, 2.0, 3.0]), "lake"))
    for df in frames.values():
        df.write.format("noop").mode("overwrite").save()
    assert {name: o.get["rows"] for name, o in watch.items()} == dict.fromkeys(frames, 3)


def bad_bars(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [
        ("a", "SSE", "1d", day, 10.0, 11.0, 10.5, 10.8, 5.0, 50.0), ("a", "SSE", "1d", day + dt.timedelta(1), 12.0, 11.0, 10.0, 9.0, 5.0, 50.0),
        ("a", "SSE", "1d", day + dt.timedelta(2), 10.0, 11.0, 9.0, 10.0, -5.0, -50.0), ("a", "SSE", "1d", day + dt.timedelta(3), 10.0, 11.0, 9.0, None, 5.0, 50.0),
        ("a", "SSE", "1d", day + dt.timedelta(9), 10.0, 11.0, 9.0, 10.5, 0.0, 0.0),
    ]
    return spark.createDataFrame(rows, (
        "symbol string, exchange string, interval string, datetime timestamp_ntz, open double, high double, low double, close double, "
        "volume double, turnover double"
    ))


def test_bad_bars_through_every_rule(spark):
    bars = bad_bars(spark)
    dwd = layers.dwd_bars(layers.ods_bars(bars, "x")).orderBy("datetime").collect()
    assert [len(r["quality_issues"]) for r in dwd] == [1, 2, 2, 1, 0]
    assert dwd[4]["vwap"] == 10.5
    assert [r["quality_score"] for r in quality.score_ods_bars(bars).orderBy("datetime").collect()] == pytest.approx([0.9, 0.8, 0.8, 0.9, 1.0])
    issues = quality.validate(bars)
    found = {(r["rule_name"], r["column"]): r for r in issues.collect()}
    assert found[("missing_values", "close")]["severity"] == "poor"
    assert found[("price_relationship", None)]["affected_records"] == 3
    assert found[("negative_values", "volume")]["severity"] == "critical"
    assert found[("time_consistency", None)]["affected_records"] == 1 and found[("time_consistency", None)]["total_records"] == 4
    row = quality.metrics(issues, bars).first()
    assert row["completeness"] == pytest.approx(0.8) and row["accuracy"] == pytest.approx(0.4)
    fixed = quality.metrics(quality.validate(bars.limit(0)), bars, corrected=True).first()
    assert fixed["overall_score"] == 1.0 and fixed["quality_level"] == "excellent"


def test_empty_table_is_one_critical_issue(spark):
    rows = quality.validate(bad_bars(spark).limit(0)).collect()
    assert len(rows) == 1 and rows[0]["severity"] == "critical" and rows[0]["rule_name"] == "completeness_check"


def test_health_without_metrics(spark):
    none = spark.createDataFrame([], "name string, value double, timestamp timestamp_ntz, event_id bigint")
    assert {r["status"] for r in metrics.health(none).collect()} == {"unhealthy"}


def test_unknown_policy_fails_compliance(spark):
    assets = spark.createDataFrame([("a", dt.datetime(2020, 1, 1), "none"), ("b", dt.datetime(2020, 1, 1), "permanent"), ("c", dt.datetime(2020, 1, 1), "years_1")],
                                   "asset_id string, created_at timestamp_ntz, policy_id string")
    checks = retention.with_expiry(assets, retention.policy_table(spark), "2024-01-01")
    row = retention.compliance_summary(checks).first()
    assert tuple(row) == (3, 1, 1, 1)


def test_value_counts_keep_types(spark):
    """Every type is counted by value: nulls apart, no number or time becomes text before the shuffle."""
    df = spark.sql("""
        select * from values (1, 1.5d, 1.50bd, date'2024-01-01', 'a', array(1)), (1, 1.5d, 2.50bd, date'2024-01-02', 'a', array(1)),
          (2, double('nan'), null, null, '', null), (null, double('nan'), 1.50bd, date'2024-01-01', null, array(2)) t(i, d, m, day, s, l)""")
    counts = profile.value_counts(df, df.columns)
    got = {r["name"]: (r["n"], r["x"]) for r in counts.groupBy("name").agg(F.count_if("known").alias("n"), F.sum(F.when(~F.col("known"), F.col("c"))).alias("x")).collect()}
    assert got == {"i": (2, 1), "d": (2, None), "m": (2, 1), "day": (2, 1), "s": (2, 1), "l": (2, 1)}
    totals = profile.table_totals(df).first()
    assert (totals["row_count"], totals["null_count"], totals["duplicate_count"], totals["unique_count"]) == (4, 5, 0, 12)
    modes = {r["column"]: (r["mode"], r["mode_count"]) for r in profile.profile_table(df).collect()}
    assert modes["s"] == ("a", 2) and modes["i"] == (None, None)
