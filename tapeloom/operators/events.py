"""Filters of event and reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions.columns import macro_code


def by_value(df: DataFrame, **equals) -> DataFrame:
    """Rows with the given values; a None is no condition."""
    for name, value in equals.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def announcements(df: DataFrame, kind: str | None = None, importance_min: int | None = None) -> DataFrame:
    df = by_value(df, announcement_type=kind)
    return df if importance_min is None else df.filter(F.col("importance") >= importance_min)


def important_announcements(df: DataFrame) -> DataFrame:
    return announcements(df, importance_min=4)


def news(df: DataFrame, sentiment: str | None = None, confidence_min: float = 0.5) -> DataFrame:
    return by_value(df, sentiment=sentiment).filter(F.col("confidence") >= confidence_min)


def reports(df: DataFrame, kind: str | None = None, rating: str | None = None) -> DataFrame:
    return by_value(df, report_type=kind, rating=rating)


def flows(df: DataFrame, kind: str | None = None) -> DataFrame:
    return by_value(df, flow_type=kind)


def themes(df: DataFrame, kind: str | None = None) -> DataFrame:
    return by_value(df, theme_type=kind)


def top_traders(df: DataFrame, kind: str | None = None) -> DataFrame:
    return by_value(df, dragon_tiger_type=kind)


def members_min_weight(df: DataFrame, weight: float = 0.01) -> DataFrame:
    return df.filter(F.col("weight") >= weight)


def top_members(df: DataFrame, n: int = 10) -> DataFrame:
    """N heaviest members per index."""
    order = Window.partitionBy("index_code").orderBy(F.col("weight").desc(), "symbol")
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn")


def industry_at_level(df: DataFrame, level: str, standard: str | None = None) -> DataFrame:
    """First class row of each symbol at a level."""
    order = Window.partitionBy("symbol").orderBy("effective_date", "industry_code")
    kept = by_value(df, industry_level=level, industry_standard=standard)
    return kept.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def macro_by_type(df: DataFrame, types: list[str]) -> DataFrame:
    """Macro points of the named types, found through their series codes."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(t,) for t in types], "wanted string").select(macro_code("wanted").alias("data_code"))
    return df.join(wanted, "data_code", "left_semi")


def audit_by(df: DataFrame, kind: str | None = None, user: int | None = None, asset: str | None = None, latest: int | None = None) -> DataFrame:
    """Audit rows by type, user or asset; optionally the newest k."""
    kept = by_value(df, event_type=kind, user_id=user, asset_id=asset)
    return kept if latest is None else kept.orderBy(F.col("timestamp").desc(), "event_id").limit(latest)
