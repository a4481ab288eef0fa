"""Range scans over keyed tables; filters and columns reach the Parquet reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.operators.joins import valid_at

BAR_SCHEMA = (
    "symbol string, exchange string, interval string, datetime timestamp_ntz, open double, high double, low double, "
    "close double, volume double, turnover double, open_interest double"
)


def scan_range(
    df: DataFrame, time: str = "datetime", start=None, end=None, columns: list[str] | None = None, order: list | None = None,
    **equals,
) -> DataFrame:
    """Rows with start <= time <= end and the given column values, ordered."""
    for name, value in equals.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    if start is not None:
        df = df.filter(F.col(time) >= F.lit(start).cast(dict(df.dtypes)[time]))
    if end is not None:
        df = df.filter(F.col(time) <= F.lit(end).cast(dict(df.dtypes)[time]))
    if order:
        df = df.orderBy(*order)
    return df.select(*columns) if columns else df


def scan_events(df: DataFrame, time: str, start=None, end=None, tiebreak: str = "doc_id", **equals) -> DataFrame:
    """Event rows of all symbols in a range, newest first per symbol."""
    return scan_range(df, time, start, end, order=["symbol", F.col(time).desc(), tiebreak], **equals)


def scan_layer(df: DataFrame, start: str, end: str, time: str = "datetime", monthly: bool = True) -> DataFrame:
    """Range scan of a table partitioned by year (and month); adds the partition predicates."""
    s, e = start.split("-"), end.split("-")
    if monthly:
        month = F.col("year") * 12 + F.col("month")
        df = df.filter(F.col("year").between(int(s[0]), int(e[0])))
        df = df.filter(month.between(int(s[0]) * 12 + int(s[1]), int(e[0]) * 12 + int(e[1])))
    else:
        df = df.filter(F.col("year").between(int(s[0]), int(e[0])))
    return scan_range(df, time, start, end)


def scan_multi(df: DataFrame, items: DataFrame, start=None, end=None, columns: list[str] | None = None) -> DataFrame:
    """Many series in one scan: semi join with an (exchange, symbol, interval) table."""
    picked = df.join(items, ["exchange", "symbol", "interval"], "left_semi")
    names = columns or ["open", "high", "low", "close", "volume"]
    out = scan_range(picked, "datetime", start, end)
    return out.select("exchange", "symbol", "interval", "datetime", *[F.col(c).cast("double").alias(c) for c in names]).orderBy(
        "symbol", "datetime"
    )


def price_window(prices: DataFrame, symbols: DataFrame, end: str, offset_days: int) -> DataFrame:
    """Prices of a symbol table in [end + offset, end]; a negative offset looks back."""
    last = F.lit(end).cast("date")
    first = F.date_add(last, offset_days)
    return prices.join(symbols.select("symbol"), "symbol", "left_semi").filter(F.col("trade_date").between(first, last))


def fundamental_asof(statements: DataFrame, as_of: str, fields: list[str], published: str = "publish_date") -> DataFrame:
    """Chosen fields per symbol as known at a date: the newest published statement."""
    known = statements.filter(F.col(published) <= F.lit(as_of).cast("date"))
    newest = F.max_by(F.struct(published, *fields), F.struct(published, "report_date"))
    return known.groupBy("symbol").agg(newest.alias("_r")).select("symbol", "_r.*")


def universe_asof(members: DataFrame, as_of: str) -> DataFrame:
    """Membership snapshot at a date, with the tradability flags."""
    ended = members if "end_date" in members.columns else members.withColumn("end_date", F.lit(None).cast("date"))
    return valid_at(ended, as_of).drop("end_date")


def recent_rows(df: DataFrame, n: int, keys=("exchange", "symbol"), time: str = "datetime") -> DataFrame:
    """Last n rows of each series."""
    return newest_rows(df, n, list(keys), [time])


def newest_rows(df: DataFrame, n: int, keys: list[str], order: list[str], buckets: int = 64) -> DataFrame:
    """The n rows of greatest ``order`` per key, pruned twice.

    Every task keeps n rows per key and hash bucket, the tasks of the buckets n rows each, and only
    ``buckets`` x n rows of a key reach its last window, however many tasks read the key.
    """
    newest = [F.col(c).desc() for c in order]
    parts = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    for by in ([*keys, "_part"], list(keys)):
        ranked = parts.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*newest)))
        parts = ranked.filter(F.col("_rn") <= n).drop("_rn")
    return parts.drop("_part")


def rows_of_day(df: DataFrame, day: str, time: str = "datetime") -> DataFrame:
    d = F.lit(day).cast("date").cast("timestamp_ntz")
    return df.filter((F.col(time) >= d) & (F.col(time) < d + F.expr("interval 1 day")))


def rows_since(df: DataFrame, now: str, minutes: int = 5, time: str = "datetime") -> DataFrame:
    t = F.lit(now).cast("timestamp_ntz")
    return df.filter((F.col(time) > t - F.expr(f"interval {minutes} minutes")) & (F.col(time) <= t))


def read_csv_bars(spark: SparkSession, path: str, schema: str = BAR_SCHEMA) -> DataFrame:
    """Bars from CSV files with a declared schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a text file; blank lines and # comments are skipped."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("symbol")).filter((F.length("symbol") > 0) & ~F.col("symbol").startswith("#"))
