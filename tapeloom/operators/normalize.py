"""Normalization of landed rows: vendor columns, cleaning, keys, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom import fixed
from tapeloom.functions.columns import norm_symbol


def dedup_keep_last(df: DataFrame, keys: list[str], sequence: list[str | Column]) -> DataFrame:
    """The row with the greatest load sequence per key.

    A combinable aggregate: a key with any number of copies shrinks to one row per task
    before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*sequence)).alias("_r"))
    return kept.select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def normalize_vendor(
    df: DataFrame, vendor: str | dict[str, str], keys: list[str], sequence: list[str]
) -> DataFrame:
    """Rename vendor columns, add missing ones (volume 0, others null), cast, keep the last row per key and date."""
    mapping = fixed.VENDOR_COLUMNS[vendor] if isinstance(vendor, str) else vendor
    renamed = df.withColumnsRenamed(mapping)
    columns = []
    for name in fixed.BAR_COLUMNS:
        if name not in renamed.columns:
            columns.append(F.lit(0.0 if name == "volume" else None).cast("double").alias(name))
        elif name == "date":
            columns.append(F.to_date("date").alias("date"))
        else:
            columns.append(F.col(name).cast("double").alias(name))
    typed = renamed.select(*keys, *columns, *sequence)
    return dedup_keep_last(typed, [*keys, "date"], list(sequence)).drop(*sequence)


def clean_ohlcv(df: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """Drop dateless rows, keep the last row per date, then keep positive closes; volume null becomes 0.

    The duplicates go first: a bad latest row removes its date.
    """
    missing = [c for c in fixed.BAR_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    dated = df.withColumn("date", F.to_date("date")).filter(F.col("date").isNotNull())
    last = dedup_keep_last(dated, [*keys, "date"], list(sequence))
    return last.filter(F.col("close") > 0).withColumn("volume", F.coalesce(F.col("volume"), F.lit(0.0)).cast("double"))


def bars_frame(df: DataFrame, sequence: list[str]) -> DataFrame:
    """Bar rows in key order, one per (exchange, symbol, interval, datetime)."""
    keys = ["exchange", "symbol", "interval", "datetime"]
    return dedup_keep_last(df, keys, list(sequence)).orderBy(*keys)


def spread_extras(df: DataFrame, extras: str, fields: list[str]) -> DataFrame:
    """Named items of a map column as columns of their own."""
    return df.withColumns({f: F.try_element_at(F.col(extras), F.lit(f)) for f in fields}).drop(extras)


def lists_to_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


def text_to_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({
        c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ",")) for c in columns
    })


def valid_symbols(df: DataFrame, column: str = "symbol") -> DataFrame:
    """Trimmed upper-case symbols; empty ones are rejected."""
    return df.withColumn(column, norm_symbol(column)).filter(F.length(column) > 0)


def project_existing(df: DataFrame, columns: list[str], keys=("symbol", "date")) -> DataFrame:
    """The columns of a metric family that the table has."""
    return df.select(*keys, *[c for c in columns if c in df.columns])


def count_duplicates(df: DataFrame) -> DataFrame:
    """Fully equal rows beyond the first, through one combinable aggregate."""
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_count"))


def schema_diff(df: DataFrame, expected: list[str]) -> DataFrame:
    """Missing and extra columns against a list of names."""
    rows = [(c, "missing") for c in expected if c not in df.columns]
    rows += [(c, "extra") for c in df.columns if c not in expected]
    return df.sparkSession.createDataFrame(rows, "column string, status string")
