"""Glue for registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeloom.functions.columns import rounded
from tapeloom.operators.normalize import dedup_keep_last
from tapeloom.operators.upsert import BAR_KEY
from tapeloom.sources.adapters import Tables

UNTIL = "2001-11-30"


def on_tables(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the adapter tables as a (spark, sf_dir) callable."""
    return lambda spark, sf_dir: fn(Tables(spark, sf_dir))


def minutes(t: Tables) -> DataFrame:
    """The ticks as a keyed table, as every upsert leaves it: of several ticks of a series at one time the greatest value counts."""
    return dedup_keep_last(t.ticks(), BAR_KEY, ["close"])


def r(c: str, digits: int, out: str | None = None):
    """Rounded output column."""
    return rounded(c, digits).alias(out or c)


def rq(expr: str, digits: int, out: str) -> str:
    """The same rounding in SQL."""
    return f"round({expr}, {digits}) + 0 AS {out}"
