"""Table profiles and range summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.quantiles import exact_quantiles

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def minute_stats(df: DataFrame, keys=("exchange", "symbol")) -> DataFrame:
    """Count, time range, last close, volume and price range per series, in one aggregate."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("row_count"), F.min("datetime").alias("first_time"), F.max("datetime").alias("last_time"),
        F.max_by("close", "datetime").alias("last_close"), F.sum("volume").alias("total_volume"),
        F.min("low").alias("min_low"), F.max("high").alias("max_high"),
    )


def series_count_range(df: DataFrame, keys: list[str], time: str = "datetime") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def kinds(df: DataFrame) -> dict[str, str]:
    """numeric, text, time or other per column."""
    out = {}
    for name, kind in df.dtypes:
        is_number = kind in _NUMERIC or kind.startswith("decimal")
        out[name] = (
            "numeric" if is_number else "text" if kind == "string" else "time" if kind.startswith(("date", "timestamp")) else "other"
        )
    return out


def _copies(df: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("_n"))


def frame_summary(df: DataFrame, data_type: str, date: str = "trade_date", symbol: str = "symbol") -> DataFrame:
    """Records, columns, date range, symbols, share of missing values, duplicate rows."""
    nulls = sum((F.col(c).isNull().cast("bigint") for c in df.columns), F.lit(0))
    n = F.sum("_n")
    has_date, has_symbol = date in df.columns, symbol in df.columns
    return _copies(df).agg(
        F.lit(data_type).alias("data_type"), n.alias("total_records"), F.lit(len(df.columns)).alias("total_columns"),
        (F.min(date) if has_date else F.lit(None)).alias("start"), (F.max(date) if has_date else F.lit(None)).alias("end"),
        (F.count_distinct(symbol) if has_symbol else F.lit(0)).alias("symbol_count"),
        (F.sum(nulls * F.col("_n")) / (n * len(df.columns))).alias("missing_ratio"), (n - F.count("*")).alias("duplicate_count"),
    )


def pivot_close(prices: DataFrame, symbols: list[str] | None = None, date: str = "trade_date") -> DataFrame:
    """Mean close per date and symbol: one row each, or one column per symbol of a named list."""
    if symbols is None:
        return prices.groupBy(date, "symbol").agg(F.avg("close").alias("close"))
    return prices.groupBy(date).pivot("symbol", symbols).agg(F.avg("close"))


def _slot(kind: str) -> str:
    """The type under which values of a column type are counted; equal values stay equal, different ones different."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return "bigint"
    if kind in ("float", "double"):
        return "double"
    return kind if kind.startswith(("decimal", "date", "timestamp")) else "string"


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, v, known, c): how often each value occurs in each column; v is the value of a text, known says that it is not null.

    One pass for all columns; equal values shrink inside every task before the shuffle. Numbers and times are
    shuffled as they are, each in the field of its type, only texts (and types without order) as text.
    """
    kind = {c: _slot(t) for c, t in df.dtypes}
    slots = sorted({kind[c] for c in columns} | {"string"})

    def cell(c: str) -> Column:
        fields = [(F.col(c) if k == kind[c] else F.lit(None)).cast(k).alias(f"v{i}") for i, k in enumerate(slots)]
        return F.struct(F.lit(c).alias("name"), F.col(c).isNotNull().alias("known"), *fields)

    values = [f"v{i}" for i in range(len(slots))]
    counted = df.select(F.inline(F.array(*map(cell, columns)))).groupBy("name", "known", *values).agg(F.count("*").alias("c"))
    return counted.select("name", F.col(f"v{slots.index('string')}").alias("v"), "known", "c")


def table_totals(df: DataFrame) -> DataFrame:
    """Rows, columns, nulls, duplicate rows and the sum of distinct values over the columns."""
    rows = _copies(df).agg(F.sum("_n").alias("row_count"), F.sum(F.col("_n") - 1).alias("duplicate_count"))
    cells = value_counts(df, df.columns).agg(
        F.coalesce(F.sum(F.when(~F.col("known"), F.col("c"))), F.lit(0)).alias("null_count"), F.count_if("known").alias("unique_count"),
    )
    # Two one-row tables side by side.
    both = rows.withColumn("_k", F.lit(1)).join(cells.withColumn("_k", F.lit(1)), "_k")
    return both.select("row_count", F.lit(len(df.columns)).alias("column_count"), "null_count", "duplicate_count", "unique_count")


def profile_table(df: DataFrame, accuracy: int = 1_000_000) -> DataFrame:
    """One row per column of any type: nulls, distinct values; numbers described, texts by mode, times by range."""
    kind = kinds(df)
    names = {k: [c for c in df.columns if kind[c] == k] for k in ("numeric", "text", "time")}
    counts = value_counts(df, df.columns)
    # Ties of the mode go to the smallest value.
    cells = counts.groupBy("name").agg(
        F.coalesce(F.sum(F.when(~F.col("known"), F.col("c"))), F.lit(0)).alias("nulls"), F.count_if("known").alias("distinct"),
        F.max(F.when(F.col("v").isNotNull(), F.col("c"))).alias("mode_count"),
        F.min_by("v", F.when(F.col("v").isNotNull(), F.struct(-F.col("c"), "v"))).alias("mode"),
    )
    text = F.col("kind") == "text"
    out = cells.withColumn("kind", F.element_at(F.create_map(*[F.lit(x) for p in kind.items() for x in p]), F.col("name")))
    out = out.withColumns({"mode": F.when(text, F.col("mode")), "mode_count": F.when(text, F.col("mode_count"))})

    def wide(cols: list[str], stats: dict, empty: str) -> DataFrame:
        if not cols:
            return df.sparkSession.createDataFrame([], empty)
        rows = F.array(*[
            F.struct(F.lit(c).alias("name"), *[fn(c).alias(s) for s, fn in stats.items()]) for c in cols
        ])
        return df.agg(rows.alias("r")).select(F.inline("r"))

    described = wide(names["numeric"], {
        "mean": F.avg, "std": F.stddev_samp, "min": lambda c: F.min(F.col(c).cast("double")), "max": lambda c: F.max(F.col(c).cast("double")),
    }, "name string, mean double, std double, min double, max double")
    spans = wide(names["time"], {
        "min_date": lambda c: F.min(F.col(c).cast("timestamp_ntz")), "max_date": lambda c: F.max(F.col(c).cast("timestamp_ntz")),
    }, "name string, min_date timestamp_ntz, max_date timestamp_ntz")
    if names["numeric"]:
        quartiles = exact_quantiles(df, [], names["numeric"], [0.25, 0.5, 0.75], accuracy)
        described = described.join(quartiles.toDF("name", "q1", "median", "q3"), "name", "left")
    else:
        described = described.selectExpr("*", "double(null) q1", "double(null) median", "double(null) q3")
    joined = out.join(described, "name", "left").join(spans, "name", "left")
    return joined.withColumn("span_days", F.datediff("max_date", "min_date").cast("bigint")).withColumnRenamed("name", "column")
