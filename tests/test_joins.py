"""Joins of many dates with intervals, and as-of joins on hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions.carry import in_blocks, last_known
from tapeloom.operators import joins, lineage, resample, series
from tapeloom.sources.adapters import Tables

SF = "/root/testdata/sf0.001"
DAY = dt.date(2020, 1, 1)


def day(k):
    return None if k is None else DAY + dt.timedelta(days=k)


def test_intervals_of_many_dates_match_all_pairs(spark):
    rng = random.Random(4)
    spans = [(rng.choice("ab"), i, rng.choice([rng.randrange(-50, 200), None]), rng.choice([None, rng.randrange(-60, 260)])) for i in range(150)]
    probes = [(rng.choice(["a", "b", None]), k, rng.choice([None, rng.randrange(0, 180)])) for k in range(80)]
    table = spark.createDataFrame([(k, i, day(a), day(b)) for k, i, a, b in spans], "key string, id int, effective_date date, end_date date")
    probe = spark.createDataFrame([(k, i, day(d)) for k, i, d in probes], "key string, n int, d date")
    want = sorted(
        (n, i) for k, n, d in probes for key, i, a, b in spans if k == key and d is not None and a is not None and a <= d and (b is None or b > d))
    for days in (1, 7, 32, 1_000):
        got = joins.valid_on(probe, table, ["key"], "d", days=days)
        assert sorted((r["n"], r["id"]) for r in got.collect()) == want
    unkeyed = joins.valid_on(probe.select("n", "d"), table, [], "d")
    assert unkeyed.count() == sum(d is not None and a is not None and a <= d and (b is None or b > d) for _, _, d in probes for _, _, a, b in spans)
    assert joins.valid_on(probe.limit(0), table, ["key"], "d").count() == 0


def test_many_dates_need_no_nested_loop(spark):
    t = Tables(spark, SF)
    found = joins.valid_on(t.prices().select("trade_date").distinct(), t.index_members(), [], "trade_date")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joins.valid_on(t.prices().select("trade_date").distinct(), t.index_members(), [], "trade_date")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan and found.count() > 0


def hot_rows(spark, n=4_000):
    """Ticks of one hot key and a few others; times are unique within a key."""
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    keys = ["hot"] * 20 + list("abc") + [None]
    times = rng.sample(range(90 * 24 * 3_600), n)
    rows = [(rng.choice(keys), start + dt.timedelta(seconds=s), rng.choice([None, 1.0, 2.0, rng.random()]), k) for k, s in enumerate(times)]
    return spark.createDataFrame(rows, "key string, at timestamp_ntz, x double, id int")


def test_chunked_asof_equals_the_plain_one(spark):
    rows = hot_rows(spark)
    probe = rows.filter("id % 3 = 0").select("key", "at", "id")
    build = rows.filter("id % 3 = 1").select("key", F.col("at").alias("since"), "x")
    plain = joins.asof_join(probe, build, ["key"], "at", "since", ["x"])
    want = sorted(map(str, plain.collect()))
    for chunk in ("1 hour", "3 days", "500 days"):
        got = joins.asof_join(probe, build, ["key"], "at", "since", ["x"], chunk=chunk)
        assert got.columns == plain.columns and sorted(map(str, got.collect())) == want
    # Build rows far before every probe row are carried over empty chunks.
    early = build.withColumn("since", F.col("since") - F.expr("interval 400 days"))
    assert sorted(map(str, joins.asof_join(probe, early, ["key"], "at", "since", ["x"], chunk="1 day").collect())) == sorted(
        map(str, joins.asof_join(probe, early, ["key"], "at", "since", ["x"]).collect()))


def test_forward_fill_over_chunks(spark):
    rows = hot_rows(spark)
    w = Window.partitionBy("key").orderBy("at")
    want = sorted(map(str, rows.withColumn("x", F.last("x", ignorenulls=True).over(w)).collect()))
    for chunk in ("1 hour", "20 days"):
        assert sorted(map(str, last_known(rows, ["key"], ["at"], ["x"], chunk).collect())) == want


@pytest.mark.parametrize("block,chunk", [(50, "1 day"), (7, "1 hour"), (10_000, "5 days")])
def test_windows_in_blocks_equal_plain_windows(spark, block, chunk):
    rows = hot_rows(spark).withColumn("x", F.coalesce("x", F.lit(0.5)))

    def compute(df, keys):
        return series.volatility_n(series.sma(df, {"m": 12}, price="x", keys=keys, order="at").withColumn("close", F.col("x")), 9, keys=keys, order="at")

    want = {r["id"]: (r["m"], r["volatility"]) for r in compute(rows, ["key"]).collect()}
    spread = in_blocks(rows, ["key"], ["at"], 11, lambda df, keys: compute(df, keys).withColumn("rows", F.count("*").over(Window.partitionBy(*keys))), block, chunk)
    found = spread.collect()
    assert len(found) == len(want)
    for r in found:
        for a, b in zip((r["m"], r["volatility"]), want[r["id"]], strict=True):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-12))
    assert max(r["rows"] for r in found) <= max(block, 11) + 11


def test_a_chain_keeps_the_volume_of_incomplete_buckets(spark):
    start = dt.datetime(2024, 1, 1, 9, 0)
    rows = [("a", "S", "tick", start, 1.0, None, 1.0, 1.0, 7.0, None, 0.0), ("a", "S", "tick", start + dt.timedelta(minutes=1), 2.0, 3.0, 1.5, 2.5, 10.0, None, 0.0),
            ("b", "S", "tick", start, None, None, None, None, 5.0, None, None)]
    schema = ("symbol string, exchange string, interval string, datetime timestamp_ntz, open double, high double, low double, close double, "
              "volume double, turnover double, open_interest double")
    bars = spark.createDataFrame(rows, schema)
    chain = resample.resample_chain(bars, ["1mo", "1m", "5m", "1h", "1d", "1w"])
    for to, made in chain.items():
        direct = resample.resample(bars, to)
        assert sorted(map(str, made.select(direct.columns).collect())) == sorted(map(str, direct.collect()))
    assert [r["volume"] for r in chain["5m"].collect()] == [17.0] and [r["volume"] for r in chain["1m"].collect()] == [10.0]


def test_paths_follow_no_dead_ends(spark):
    wide = [("s", f"dead{i}") for i in range(300)] + [(f"dead{i}", f"deader{i}") for i in range(300)]
    edges = spark.createDataFrame([("s", "m"), ("m", "t"), ("m", "m2"), ("m2", "t"), ("t", "s"), *wide], "source_id string, target_id string")
    ends = spark.createDataFrame([("s",), ("t",), ("nowhere",)], "node_id string")
    useful = lineage.reachable(edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")), ends.filter("node_id = 't'"))
    assert sorted(r["node_id"] for r in useful.collect()) == ["m", "m2", "s", "t"]
    assert lineage.useful_steps(edges, useful).count() == 5
    found = lineage.paths(edges, ends.filter("node_id = 's'"), ends.filter("node_id <> 's'"))
    assert sorted(r["path"] for r in found.collect()) == [["s", "m", "m2", "t"], ["s", "m", "t"]]
    assert lineage.paths(edges, ends, ends.filter("node_id = 'nowhere'")).collect()[0]["path"] == ["nowhere"]
