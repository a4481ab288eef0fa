"""Stored layers: counts out of the writing run, and refreshes that equal a full run."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.plans import lake
from tapeloom.sinks import tables as sinks

SCHEMA = (
    "symbol string, exchange string, interval string, datetime timestamp_ntz, open double, high double, low double, "
    "close double, volume double, turnover double, open_interest double"
)
START = dt.datetime(2021, 1, 1)


def bars(spark, rows):
    return spark.createDataFrame(
        [(s, "SSE", "1d", START + dt.timedelta(days=d), c, c + 1, c - 1, c, v, c * v, 0.0) for (s, d), (c, v) in sorted(rows.items())], SCHEMA)


def factors(spark, marks):
    return spark.createDataFrame([("SSE", s, START + dt.timedelta(days=d), f) for s, d, f in marks], "exchange string, symbol string, datetime timestamp_ntz, adj_factor double")


def some_rows(seed):
    rng = random.Random(seed)
    daily = {("a", d): (rng.uniform(5, 9), rng.uniform(1, 5)) for d in range(0, 500) if rng.random() < 0.7}
    sparse = {("b", d): (rng.uniform(5, 9), rng.uniform(1, 5)) for d in range(3, 500, 11)}
    return daily | sparse


def tables(spark, path):
    out = {}
    for name in ("ods_bars", "dwd_bars", "dws_adjusted", "dws_factors"):
        table = sinks.read_table(spark, f"{path}/{name}")
        stamps = [c for c in table.columns if c.endswith("_at") or c == "quality_issues"]
        out[name] = sorted((tuple(r) for r in table.select(*sorted(set(table.columns) - set(stamps))).collect()), key=str)
    return out


@pytest.mark.parametrize("case", ["end", "middle", "restated", "two months", "factor day", "no factors"])
def test_refresh_equals_a_full_run(spark, case):
    rows = some_rows(7)
    marks = [("a", d, 1 + d / 1000) for d in range(0, 500, 37)] + [("b", 3, 1.5), ("b", 256, 2.0)]
    if case == "no factors":
        marks = None
    elif case != "factor day":
        marks = [m for m in marks if m[:2] in rows and m[1] not in range(150, 210) and m[1] < 470 and m[1] not in range(20, 30)]
    days = {"end": range(470, 500), "middle": range(170, 200), "two months": [*range(20, 30), *range(170, 180)]}.get(case, range(180, 200))
    new = {k: v for k, v in rows.items() if k[1] in days}
    old = {k: v for k, v in rows.items() if k not in new}
    if case == "restated":
        old = rows
        new = {k: (c * 2, v + 1) for k, (c, v) in new.items()}
    table = None if marks is None else factors(spark, marks)
    one, two = sinks.scratch_path(spark, "lake"), sinks.scratch_path(spark, "lake")
    lake.run_bar_layers(bars(spark, old), "x", one, table)
    rewritten = lake.refresh_bar_layers(spark, one, bars(spark, new), "x", table)
    counts = lake.run_bar_layers(bars(spark, old | new), "x", two, table)
    assert tables(spark, one) == tables(spark, two)
    assert {r["n"] for r in counts.collect()} == {len(rows)}
    whole = {12 * d.year + d.month - 1 for d in (START + dt.timedelta(days=k[1]) for k in rows)}
    assert set(rewritten["dwd_bars"]) < whole and set(rewritten["dwd_bars"]) <= set(rewritten["dws_factors"])
    if case == "end":
        assert rewritten["dws_factors"] == rewritten["dwd_bars"] == rewritten["dws_adjusted"]


def test_counts_come_from_the_writing_tasks(spark):
    path = sinks.scratch_path(spark, "lake")
    rows = some_rows(3)
    found = {r["layer"]: (r["n"], str(r["first_date"])) for r in lake.run_bar_layers(bars(spark, rows), "x", path).collect()}
    assert found == dict.fromkeys(("ods_bars", "dwd_bars", "dws_adjusted", "dws_factors"), (len(rows), "2021-01-01"))
    empty = lake.run_bar_layers(bars(spark, rows).filter(F.lit(False)), "x", sinks.scratch_path(spark, "lake"))
    assert {r["n"] for r in empty.collect()} == {0}


def test_nothing_new_changes_nothing(spark):
    path = sinks.scratch_path(spark, "lake")
    rows = some_rows(5)
    lake.run_bar_layers(bars(spark, rows), "x", path)
    assert lake.refresh_bar_layers(spark, path, bars(spark, rows).filter(F.lit(False)), "x") == {}


@pytest.mark.parametrize("day", [185, 300])
def test_repeated_factors_count_once_in_a_run_and_a_refresh(spark, day):
    rows = some_rows(9) | {("a", d): (6.0, 2.0) for d in (185, 300)}
    marks = factors(spark, [("a", day, 2.0), ("a", day, 1.5), ("a", day, None), ("b", 3, 1.5)])
    old = {k: v for k, v in rows.items() if k[1] not in range(180, 200)}
    one, two = sinks.scratch_path(spark, "lake"), sinks.scratch_path(spark, "lake")
    lake.run_bar_layers(bars(spark, old), "x", one, marks)
    lake.refresh_bar_layers(spark, one, bars(spark, {k: v for k, v in rows.items() if k not in old}), "x", marks)
    assert {r["n"] for r in lake.run_bar_layers(bars(spark, rows), "x", two, marks).collect()} == {len(rows)}
    assert tables(spark, one) == tables(spark, two)
