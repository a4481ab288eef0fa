"""Bar aggregation to a coarser interval, by combinable aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.series import KEYS
from tapeloom.session import materialize

MINUTES = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour"}
TARGETS = (*MINUTES, "1d", "1w", "1mo")


def bucket(ts: str, to: str, month_end: bool = False) -> Column:
    """Label of the interval that holds ``ts``: its start, the Sunday of a week, the first of a month."""
    if to in MINUTES:
        return F.window(ts, MINUTES[to])["start"]
    day = F.to_date(ts)
    if to == "1d":
        label = day
    elif to == "1w":
        label = F.date_add(F.trunc(day, "week"), 6)
    elif to == "1mo":
        label = F.last_day(day) if month_end else F.trunc(day, "month")
    else:
        raise ValueError(f"no rule for interval {to!r}")
    return label.cast("timestamp_ntz")


def with_defaults(bars: DataFrame) -> DataFrame:
    """Turnover = close x volume and open interest 0 where the columns or values are missing."""
    implied = F.col("close") * F.col("volume")
    turnover = F.coalesce(F.col("turnover"), implied) if "turnover" in bars.columns else implied
    interest = F.coalesce(F.col("open_interest"), F.lit(0.0)) if "open_interest" in bars.columns else F.lit(0.0)
    return bars.withColumns({"turnover": turnover, "open_interest": interest})


def resample(bars: DataFrame, to: str, keys=KEYS, month_end: bool = False) -> DataFrame:
    """First open, highest high, lowest low, last close, summed volume; incomplete buckets are dropped."""
    return complete(_buckets(with_defaults(bars), to, keys, month_end))


def complete(bars: DataFrame) -> DataFrame:
    """Bars with all four prices."""
    return bars.na.drop("any", subset=["open", "high", "low", "close"])


def resample_chain(bars: DataFrame, targets: list[str], keys=KEYS) -> dict[str, DataFrame]:
    """Every target from the next finer one of the list, weeks and months from days; the bars are read once.

    Buckets that lack a price go on inside the chain, since their volume belongs to the coarser ones, and are dropped
    from what is returned only.
    """
    made: dict[str, DataFrame] = {}
    for to in sorted(targets, key=TARGETS.index):
        finer = [t for t in made if t not in ("1w", "1mo")]
        source = made[finer[-1]] if finer else with_defaults(bars)
        made[to] = materialize(_buckets(source, to, keys))
    return {to: complete(part) for to, part in made.items()}


def _buckets(bars: DataFrame, to: str, keys, month_end: bool = False) -> DataFrame:
    by = [k for k in keys if k != "interval"]
    ts = F.col("datetime")

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), ts)

    out = bars.groupBy(*by, bucket("datetime", to, month_end).alias("bucket")).agg(
        F.min_by("open", known("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", known("close")).alias("close"), F.sum("volume").alias("volume"),
        F.sum("turnover").alias("turnover"), F.max_by("open_interest", known("open_interest")).alias("open_interest"),
    )
    return out.withColumnRenamed("bucket", "datetime").withColumn("interval", F.lit(to))
