"""Joins: point-in-time, interval, adjustment and series alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions.carry import last_known

PRICES = ("open", "high", "low", "close")


def asof_join(
    probe: DataFrame, build: DataFrame, keys: list[str], probe_time: str, build_time: str, fields: list[str], chunk: str | None = None
) -> DataFrame:
    """Attach to every probe row the newest build row of its key with build_time <= probe_time.

    Union and carry: both sides share one shuffle by key and one sort by time, so no range
    join and no row pairs arise. Where a key may hold more rows than a task should sort, ``chunk`` (such as "30 days")
    cuts it into time chunks, and the newest build row of the earlier ones is carried in by a table of one row per chunk.
    """
    payload = F.struct(build_time, *fields)
    left = probe.select(*keys, F.col(probe_time).alias("_t"), F.lit(1).alias("_side"),
                        F.struct(*probe.columns).alias("_p"), F.lit(None).cast(build.select(payload).dtypes[0][1]).alias("_b"))
    right = build.select(*keys, F.col(build_time).cast(dict(probe.dtypes)[probe_time]).alias("_t"),
                         F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_p"].dataType).alias("_p"),
                         payload.alias("_b"))
    carry = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right)
    if chunk is None:
        merged = both.withColumn("_b", F.last("_b", ignorenulls=True).over(carry))
    else:
        merged = last_known(both, keys, ["_t", "_side"], ["_b"], chunk)
    found = merged.filter("_side = 1")
    as_of = F.col(f"_b.{build_time}").alias(f"known_{build_time}")
    return found.select("_p.*", as_of, *[F.col(f"_b.{f}").alias(f) for f in fields])


def asof_snapshot(df: DataFrame, keys: list[str], time: str, as_of, fields: list[str] | None = None) -> DataFrame:
    """Newest row per key with time <= ``as_of``, as one combinable aggregate."""
    rest = [c for c in (fields or df.columns) if c not in (*keys, time)]
    known = df.filter(F.col(time) <= F.lit(as_of))
    newest = known.groupBy(*keys).agg(F.max_by(F.struct(time, *rest), time).alias("_r"))
    return newest.select(*keys, "_r.*")


def valid_at(df: DataFrame, as_of, start: str = "effective_date", end: str = "end_date") -> DataFrame:
    """Rows whose [start, end) covers ``as_of`` (a date or a column)."""
    d = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    return df.filter((F.col(start) <= d) & (F.col(end).isNull() | (F.col(end) > d)))


def valid_on(
    probe: DataFrame, intervals: DataFrame, keys: list[str], date: str, start: str = "effective_date", end: str = "end_date", days: int = 32
) -> DataFrame:
    """Every probe row with all interval rows of its keys whose [start, end) covers its date; an open end is null.

    Dates are cut into buckets of ``days``. An interval is repeated once per bucket it touches inside the range of the
    probe's dates (one row, read first), so the join is an equality on (keys, bucket) and the exact bounds are
    checked inside a bucket; no pair outside it arises. Rows with a null date or start match nothing.

    Without keys every interval meets all dates it covers, so a small input makes a large result: the intervals are dealt
    over many tasks first, whatever their size, and a calendar's worth of dates goes to each of them.
    """
    number = F.floor(F.unix_date(F.col(date).cast("date")) / days).cast("int")
    bucketed = probe.withColumn("_bucket", number)
    span = bucketed.agg(F.min("_bucket").alias("a"), F.max("_bucket").alias("b"), F.count("*").alias("n")).first()
    low, high = (0, -1) if span["a"] is None else (span["a"], span["b"])

    def bucket(c: Column) -> Column:
        return F.floor(F.unix_date(c.cast("date")) / days).cast("int")

    first = F.greatest(bucket(F.col(start)), F.lit(low))
    last = F.least(F.coalesce(bucket(F.date_sub(F.col(end).cast("date"), 1)), F.lit(high)), F.lit(high))
    # A bucket is not touched by an interval that is empty or lies outside the probe's dates.
    real = F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start)))
    touching = intervals.filter(real & (first <= last))
    if not keys:
        pieces = max(64, 4 * probe.sparkSession.sparkContext.defaultParallelism)
        touching = touching.repartition(pieces)
        bucketed = F.broadcast(bucketed) if span["n"] <= 100_000 else bucketed.repartition(pieces)
    spread = touching.withColumn("_bucket", F.explode(F.sequence(first, last)))
    joined = bucketed.join(spread, [*keys, "_bucket"])
    return joined.filter((F.col(start) <= F.col(date)) & (F.col(end).isNull() | (F.col(end) > F.col(date)))).drop("_bucket")


def tradable_only(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Keep symbols whose universe row is tradable."""
    return df.join(universe.filter("is_tradable").select("symbol"), "symbol", "left_semi")


def factor_ratio(
    bars: DataFrame, factors: DataFrame, side: str = "qfq", keys=("exchange", "symbol"), order: str = "datetime"
) -> DataFrame:
    """Add ``ratio``: the filled factor against the last one.

    ``qfq`` is f / f_last, ``hfq`` its inverse, ``hfq_first`` the usual f / f_first; rows
    before the first factor have none.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    joined = bars.join(factors.select(*keys, order, "adj_factor"), [*keys, order], "left")
    filled = joined.withColumn(
        "adj_factor", F.last("adj_factor", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    last, first = F.last("adj_factor").over(whole), F.first("adj_factor", ignorenulls=True).over(whole)
    f = F.col("adj_factor")
    ratios = {"qfq": F.try_divide(f, last), "hfq": F.try_divide(last, f), "hfq_first": F.try_divide(f, first)}
    return filled.withColumn("ratio", ratios[side])


def adjust_ratio(bars: DataFrame, factors: DataFrame, side: str = "qfq", **kw) -> DataFrame:
    """OHLC scaled by the factor ratio of the asked side."""
    scaled = factor_ratio(bars, factors, side, **kw)
    return scaled.withColumns({c: F.col(c) * F.col("ratio") for c in PRICES})


def apply_adjust(
    bars: DataFrame, factors: DataFrame, mode: str = "exact", keys=("exchange", "symbol"), order: str = "datetime"
) -> DataFrame:
    """Multiply OHLC by the factor, filled forward.

    ``exact`` takes only factors dated on a bar; ``asof`` takes every factor up to the bar.
    """
    if mode == "asof":
        joined = asof_join(bars, factors, list(keys), order, order, ["adj_factor"]).drop(f"known_{order}")
    else:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        matched = bars.join(factors.select(*keys, order, "adj_factor"), [*keys, order], "left")
        joined = matched.withColumn("adj_factor", F.last("adj_factor", ignorenulls=True).over(w))
    return joined.withColumns({c: F.col(c) * F.col("adj_factor") for c in PRICES})


def align_series(df: DataFrame, codes: list[str], code: str = "data_code", date: str = "date", value: str = "value") -> DataFrame:
    """One column per code, complete dates only."""
    return df.groupBy(date).pivot(code, codes).agg(F.first(value)).na.drop("any")
