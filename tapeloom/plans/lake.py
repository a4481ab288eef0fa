"""The layers of the lake as stored tables: a run that counts what it writes, and a refresh of what changed.

A run of the bar layers moves each bar twice, to its series and to its month, and keeps it there with all columns that any layer needs; the
layers follow row by row, counted by the tasks that write them. A run of the statement layers reads each layer back for the next one. A refresh merges
new bars into the raw layer and recomputes only the months whose rows can differ: clean bars where bars
changed; factors there and in the 20 bars of a series after them, from the 20 bars before; adjusted prices where
bars changed, or everywhere if a new bar makes another factor count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions.quantiles import matched
from tapeloom.operators import layers
from tapeloom.operators.joins import asof_join
from tapeloom.operators.series import KEYS
from tapeloom.operators.upsert import BAR_KEY
from tapeloom.session import materialize, settings
from tapeloom.sinks import tables as sinks

#: Bars that a factor row looks back.
LOOK_BACK = 20
#: Rows that a task reads are sorted in memory before they move or are written.
SMALL_SPLITS = {"spark.sql.files.maxPartitionBytes": "32m"}
BAR_PARTS = ["exchange", "interval", "year", "month"]
PARTS = {
    "ods_bars": BAR_PARTS, "dwd_bars": BAR_PARTS, "dws_adjusted": ["exchange", "year", "month"], "dws_factors": ["exchange", "year", "month"],
    "ods_financial": ["year"], "dwd_financial": ["year"], "dws_merged": ["year"],
}


def _stored(
    df: DataFrame, path: str, name: str, time: str, monthly: bool = True, rebalance: bool = True
) -> tuple[DataFrame, Observation]:
    """Write a layer, counting it on the way, and read it back."""
    watch = Observation(name)
    measures = [F.count(F.lit(1)).alias("n"), F.min(time).alias("first_time"), F.max(time).alias("last_time")]
    _write_dated(df, path, name, time, monthly, watch=watch, measures=measures, rebalance=rebalance)
    # With the schema given, an empty layer can be read as well.
    schema = sinks.with_period(df, time, monthly).schema
    return df.sparkSession.read.schema(schema).parquet(f"{path}/{name}"), watch


def _write_dated(
    df: DataFrame, path: str, name: str, time: str = "datetime", monthly: bool = True, finish: Callable[[DataFrame], DataFrame] | None = None, **kw
) -> None:
    """Write rows to a layer by the period of their time."""
    def dated(rows: DataFrame) -> DataFrame:
        return sinks.with_period(finish(_period_free(rows)), time, monthly)

    sinks.write_table(sinks.with_period(df, time, monthly), f"{path}/{name}", PARTS[name], ["symbol", time], finish=dated if finish else None, **kw)


def _report(spark: SparkSession, watched: dict[str, Observation]) -> DataFrame:
    """(layer, n, first_date, last_date) of the layers, as the writing tasks counted them."""
    rows = [(name, seen["n"], *(None if seen[c] is None else seen[c].isoformat()[:10] for c in ("first_time", "last_time")))
            for name, seen in ((name, watch.get) for name, watch in watched.items())]
    counted = spark.createDataFrame(rows, "layer string, n long, first_date string, last_date string")
    return counted.withColumns({c: F.col(c).cast("date") for c in ("first_date", "last_date")})


def _period_free(df: DataFrame) -> DataFrame:
    return df.drop("year", "month")


def run_bar_layers(bars: DataFrame, source: str, path: str, factors: DataFrame | None = None, at=None, tasks: int | None = None) -> DataFrame:
    """Write the four bar layers below ``path``; returns their counts.

    ``tasks`` says that the bars lie by exchange and symbol over so many tasks (``Tables.bars``); they are dealt so without it.
    """
    rows, watched = by_month(bars, factors, tasks), {}
    ods = layers.ods_bars(layers.own_columns(rows, bars.columns), source, at)
    made = {
        "ods_bars": ods, "dwd_bars": layers.dwd_bars(ods, at=at),
        "dws_adjusted": layers.adjusted_by(rows, at), "dws_factors": layers.factors_by(rows, at),
    }
    with settings(bars.sparkSession, SMALL_SPLITS):
        for name, layer in made.items():
            _, watched[name] = _stored(layer, path, name, "datetime", rebalance=False)
    return _report(bars.sparkSession, watched)


def by_month(bars: DataFrame, factors: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """``layers.along_series`` of bars, kept month by month in the shared folder."""
    spark = bars.sparkSession
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = bars if tasks else bars.repartition(number, "exchange", "symbol")
    with sinks.without_reshuffle(spark), settings(spark, SMALL_SPLITS | {"spark.sql.shuffle.partitions": str(max(number, tasks or 0))}):
        rows = sinks.with_period(layers.along_series(dealt, factors, tasks or number), "datetime")
        return _period_free(materialize(rows.hint("rebalance", *BAR_PARTS).sortWithinPartitions(*BAR_PARTS, "symbol", "datetime")))


def run_financial_layers(ods: DataFrame, fundamentals: DataFrame, path: str, at=None) -> DataFrame:
    """Write the three statement layers below ``path``; returns their counts."""
    watched = {}
    landed, watched["ods_financial"] = _stored(ods, path, "ods_financial", "report_date", monthly=False)
    dwd, watched["dwd_financial"] = _stored(layers.dwd_financial(landed.drop("year"), at=at), path, "dwd_financial", "report_date", monthly=False)
    merged = layers.dws_merged(dwd.drop("year"), fundamentals, at)
    _, watched["dws_merged"] = _stored(merged, path, "dws_merged", "report_date", monthly=False)
    return _report(ods.sparkSession, watched)


def _month(year: Column, month: Column) -> Column:
    return year * 12 + month - 1


def _months(df: DataFrame) -> list[int]:
    """The distinct months of a table with year and month; one value per partition."""
    found = df.select(_month(F.col("year"), F.col("month")).alias("m")).distinct().collect()
    return sorted(r["m"] for r in found)


def _between(table: DataFrame, first: int, last: int) -> DataFrame:
    """The months first..last of a stored table; the years alone already prune its folders."""
    years = F.col("year").between(first // 12, last // 12)
    return table.filter(years & _month(F.col("year"), F.col("month")).between(first, last))


def _blocks(months: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive months."""
    out: list[tuple[int, int]] = []
    for m in months:
        out = [*out[:-1], (out[-1][0], m)] if out and m == out[-1][1] + 1 else [*out, (m, m)]
    return out


def _reached(dwd: DataFrame, changed: DataFrame, first: int) -> list[int]:
    """Months that hold a changed bar or one of the LOOK_BACK bars of its series after it."""
    later = _between(dwd, first, _months_after(dwd, changed, first)).select(*KEYS, "datetime", "year", "month")
    marked = matched(later, changed.select(*KEYS, "datetime").distinct().withColumn("hit", F.lit(1)), [*KEYS, "datetime"], "left")
    line = Window.partitionBy(*KEYS).orderBy("datetime")
    numbered = marked.withColumn("rn", F.row_number().over(line))
    last_hit = F.max(F.when(F.col("hit") == 1, F.col("rn"))).over(line.rowsBetween(Window.unboundedPreceding, 0))
    return _months(numbered.withColumn("last_hit", last_hit).filter(F.col("rn") - F.col("last_hit") <= LOOK_BACK))


def _months_after(dwd: DataFrame, changed: DataFrame, first: int) -> int:
    """Until which month every changed series has LOOK_BACK bars after its changes, or all that exist; looks on 2, 4, 8 ... months."""
    last = _months(changed)[-1]
    newest = dwd.filter(F.col("year") >= first // 12).agg(F.max(_month(F.col("year"), F.col("month"))).alias("m")).first()["m"]
    series = changed.select(*KEYS).distinct()
    on = 2
    while last + on < newest:
        after = matched(_between(dwd, last + 1, last + on).select(*KEYS), series, list(KEYS), "left_semi").groupBy(*KEYS).count()
        short = matched(series, after.filter(F.col("count") >= LOOK_BACK), list(KEYS), "left_anti")
        if short.isEmpty():
            return last + on
        on *= 2
    return max(newest, last)


def _months_before(dwd: DataFrame, first: int, last: int) -> int:
    """From which month on every series of first..last has its LOOK_BACK earlier bars, or all that exist; looks back 2, 4, 8 ... months."""
    oldest = dwd.agg(F.min(_month(F.col("year"), F.col("month"))).alias("m")).first()["m"]
    inside = _between(dwd, first, last).select(*KEYS).distinct()
    back = 2
    while first - back > oldest:
        before = matched(_between(dwd, first - back, first - 1).select(*KEYS), inside, list(KEYS), "left_semi").groupBy(*KEYS).count()
        short = matched(inside, before.filter(F.col("count") >= LOOK_BACK), list(KEYS), "left_anti")
        if short.isEmpty():
            return first - back
        back *= 2
    return min(oldest, first)


def refresh_bar_layers(
    spark: SparkSession, path: str, new: DataFrame, source: str, factors: DataFrame | None = None, at=None, sequence: tuple[str, ...] = ("datetime",)
) -> dict[str, list[int]]:
    """Merge new bars into stored layers; returns the rewritten months (year * 12 + month - 1) per layer."""
    landed = materialize(sinks.with_period(layers.ods_bars(new, source, at), "datetime"))
    touched = _months(landed)
    if not touched:
        return {}
    table = {name: f"{path}/{name}" for name in PARTS}
    factors = None if factors is None else materialize(layers.unique_factors(factors))
    # A bar on the day of a factor that had no bar before changes what the factor reaches.
    known = _between(sinks.read_table(spark, table["ods_bars"]), touched[0], touched[-1])
    added = matched(landed, known.select(*BAR_KEY), BAR_KEY, "left_anti")
    dated = factors is not None and not matched(added, factors.select("exchange", "symbol", "datetime"), ["exchange", "symbol", "datetime"], "left_semi").isEmpty()
    sinks.upsert_table(spark, table["ods_bars"], landed, BAR_KEY, BAR_PARTS, list(sequence), cluster=["symbol", "datetime"])

    ods = sinks.only_partitions(sinks.read_table(spark, table["ods_bars"]), landed, BAR_PARTS)
    _write_dated(layers.dwd_bars(_period_free(ods), at=at), path, "dwd_bars")

    dwd = sinks.read_table(spark, table["dwd_bars"])
    reached = _reached(dwd, landed, touched[0])
    for first, last in _blocks(reached):
        around = _period_free(_between(dwd, _months_before(dwd, first, last), last))
        fresh = _between(sinks.with_period(layers.measured(around), "datetime"), first, last)
        _write_dated(_period_free(fresh), path, "dws_factors", finish=lambda rows: layers.factors_by(rows, at))

    if dated:
        rewritten = _months(dwd)
        fresh = layers.rated_by_series(_period_free(dwd), factors)
    else:
        rewritten = touched
        inside = F.lit(False)
        for first, last in _blocks(touched):
            inside = inside | _month(F.col("year"), F.col("month")).between(first, last)
        part = _period_free(_between(dwd, touched[0], touched[-1]).filter(inside))
        fresh = _rated(part, dwd, factors).select(*KEYS, "datetime", *layers.PRICES, "ratio")
    with sinks.without_reshuffle(spark):
        _write_dated(fresh, path, "dws_adjusted", finish=lambda rows: layers.adjusted_by(rows, at))
    return {"ods_bars": touched, "dwd_bars": touched, "dws_factors": reached, "dws_adjusted": rewritten}


def _rated(part: DataFrame, dwd: DataFrame, factors: DataFrame | None) -> DataFrame:
    """Some bars with the ratio they have in the whole table; of the other bars only keys are read, and only on factor days."""
    if factors is None:
        return part.withColumn("ratio", F.lit(1.0))
    series = ["exchange", "symbol"]
    marks = matched(factors.select(*series, "datetime", "adj_factor"), dwd.select(*series, "datetime"), [*series, "datetime"], "left_semi")
    last = marks.groupBy(*series).agg(F.max_by("adj_factor", "datetime").alias("_last"))
    filled = asof_join(part, marks, series, "datetime", "datetime", ["adj_factor"])
    return matched(filled, last, series, "left").withColumn("ratio", F.try_divide("adj_factor", "_last"))
