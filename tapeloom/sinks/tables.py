"""Partitioned Parquet tables: writes, dynamic overwrite, upsert, purge and exports."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.quantiles import matched
from tapeloom.operators.normalize import dedup_keep_last
from tapeloom.operators.upsert import upsert
from tapeloom.session import materialize, scratch_path  # noqa: F401 - scratch_path is part of this module's surface


def with_period(df: DataFrame, time: str, monthly: bool = True) -> DataFrame:
    """Partition columns year and month taken from the row's own time."""
    df = df.withColumn("year", F.year(time))
    return df.withColumn("month", F.month(time)) if monthly else df


def write_table(
    df: DataFrame, path: str, partitions: list[str], cluster: list[str] = (), codec: str = "zstd", watch: Observation | None = None,
    measures: list[Column] = (), finish: Callable[[DataFrame], DataFrame] | None = None, rebalance: bool = True,
) -> None:
    """Overwrite the partitions present in ``df``.

    Rows are rebalanced by partition, so that a large partition is split over tasks and
    small ones share a file, and sorted for row-group statistics; ``rebalance`` is False for rows that lie so already, or that
    all go to one partition. ``finish`` adds the columns that follow from a row itself, once it has been moved. ``watch`` takes the aggregates ``measures`` of what
    is written, in the tasks that write it.
    """
    laid_out = df.hint("rebalance", *partitions) if partitions and rebalance else df
    if finish is not None:
        laid_out = finish(laid_out)
    if cluster:
        laid_out = laid_out.sortWithinPartitions(*partitions, *cluster)
    if watch is not None:
        laid_out = laid_out.observe(watch, *measures)
    writer = laid_out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", codec)
    writer.partitionBy(*partitions).parquet(path)
    _remember_columns(laid_out, path)


def _schema_folder(path: str) -> str:
    """Beside the data: Spark lists no folder whose name starts with an underscore."""
    return f"{path.rstrip('/')}/_schema"


def _remember_columns(df: DataFrame, path: str, known: T.StructType | None = None) -> None:
    """Keep the united columns of all writes beside the data, so that no later read opens every footer for them.

    Only tables that were merged into have this record; ``known`` starts it.
    """
    spark = df.sparkSession
    stored = _stored_columns(spark, path)
    base = known or stored
    if base is None:
        return
    names = {f.name for f in base.fields}
    united = T.StructType([*base.fields, *[f for f in df.schema.fields if f.name not in names]])
    if united != stored:
        spark.createDataFrame([(united.json(),)], "value string").coalesce(1).write.mode("overwrite").text(_schema_folder(path))


def _stored_columns(spark: SparkSession, path: str) -> T.StructType | None:
    if not table_exists(spark, _schema_folder(path)):
        return None
    row = spark.read.text(_schema_folder(path)).first()
    return T.StructType.fromJson(json.loads(row["value"])) if row else None


def write_bucketed(df: DataFrame, name: str, keys: list[str], order: list[str], buckets: int = 32) -> DataFrame:
    """A catalog table whose rows lie in ``buckets`` files by hash of ``keys``, each sorted by keys and order.

    Grouping, joins and windows on the keys (and more columns) then need no shuffle; see ``without_reshuffle`` for joins on more. The
    data lie in the shared folder; the catalog name gets a suffix of its own.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex[:12]}"
    laid_out = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys, *order)
    laid_out.format("parquet").option("path", scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table)


@contextmanager
def without_reshuffle(spark: SparkSession) -> Iterator[None]:
    """Let joins on (keys, more) that are planned inside use tables bucketed by keys alone, which Spark does not do by default.

    A key that holds a large part of the rows then stays in one task, so it is for series with a bound.
    """
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


#: Types of partition columns; every other one is text, so the interval "1d" or the symbol "000001" stays as written.
PARTITION_TYPES = {"year": "int", "month": "int", "day": "int", "hour": "int", "load_date": "date", "dt": "date"}


def _folder(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _folder(spark, path)
    return fs.exists(folder)


def _partition_columns(spark: SparkSession, path: str) -> list[str]:
    """Names of the partition columns, from one branch of the folders."""
    fs, folder = _folder(spark, path)
    names: list[str] = []
    while True:
        below = [x.getPath() for x in fs.listStatus(folder) if x.isDirectory() and "=" in x.getPath().getName()]
        if not below:
            return names
        folder = below[0]
        names.append(folder.getName().partition("=")[0])


def read_table(spark: SparkSession, path: str, types: dict[str, str] | None = None, evolved: bool = False) -> DataFrame:
    """A written table whose partition columns have their declared types (PARTITION_TYPES, then text).

    ``evolved`` unites the columns of all writes, for a table that gained columns: from the record beside the data, or
    once, where there is none, from the footers of all files.
    """
    known = _stored_columns(spark, path) if evolved else None
    declared = PARTITION_TYPES | (types or {})
    parts = {c: T._parse_datatype_string(declared.get(c, "string")) for c in _partition_columns(spark, path)}
    found = known or spark.read.option("mergeSchema", evolved).parquet(path).schema
    fields = [T.StructField(f.name, parts.get(f.name, f.dataType)) for f in found.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def only_partitions(table: DataFrame, wanted: DataFrame, partitions: list[str]) -> DataFrame:
    """Rows of the partitions in ``wanted``.

    Their values, one row per partition, are gathered first: as plain filters they prune the folders
    before the scan, which a join does not do.
    """
    rows = wanted.select(*partitions).distinct().collect()
    for name in partitions:
        values = {r[name] for r in rows}
        known = F.col(name).isin([v for v in values if v is not None])
        table = table.filter(known | F.col(name).isNull() if None in values else known)
    return matched(table, wanted.select(*partitions).distinct(), partitions, "left_semi")


def upsert_table(
    spark: SparkSession, path: str, new: DataFrame, keys: list[str], partitions: list[str], sequence: list[str], **kw
) -> None:
    """Merge ``new`` into a table, or create it; only partitions present in ``new`` are read and written.

    The row of greatest ``sequence`` wins per key. Sequence columns that an existing table lacks are not stored;
    other new columns are, and earlier files read null there.
    """
    new = materialize(dedup_keep_last(new, keys, sequence))
    if not table_exists(spark, path):
        write_table(new, path, partitions, **kw)
        return
    current = read_table(spark, path, {c: t for c, t in new.dtypes if c in partitions}, evolved=True)
    _remember_columns(current, path, current.schema)
    merged = materialize(upsert(only_partitions(current, new, partitions), new, keys, sequence))
    write_table(merged.drop(*[c for c in sequence if c not in current.columns]), path, partitions, **kw)


def write_bars(df: DataFrame, path: str) -> None:
    """Layer layout of bars: exchange, interval, year, month; clustered by symbol and time."""
    write_table(with_period(df, "datetime"), path, ["exchange", "interval", "year", "month"], ["symbol", "datetime"])


def write_statements(df: DataFrame, path: str, time: str = "report_date") -> None:
    write_table(with_period(df, time, monthly=False), path, ["year"], ["symbol", time])


def write_events(df: DataFrame, path: str, load_date: str, time: str) -> None:
    """Event rows stamped with the load day; a reload on the same day replaces that day's part.

    A load is one partition, so its rows are written where they are, without a shuffle by partition.
    """
    write_table(df.withColumn("load_date", F.lit(load_date).cast("date")), path, ["load_date"], ["symbol", time], "snappy", rebalance=False)


def read_latest_load(spark: SparkSession, path: str, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """Events with reloads settled: the newest load wins per key. Of other columns than the key and the load day only ``columns`` are read, if given."""
    table = read_table(spark, path)
    if columns is not None:
        table = table.select(*dict.fromkeys([*key, *columns, "load_date"]))
    return dedup_keep_last(table, key, ["load_date"])


def write_by(df: DataFrame, path: str, partitions: list[str], cluster: list[str] = ()) -> None:
    write_table(df, path, partitions, list(cluster))


def write_signals(df: DataFrame, path: str, strategy: str | None = None) -> None:
    """One partition per strategy and trade date."""
    name = F.col("model_name") if strategy is None else F.lit(strategy)
    write_table(df.withColumns({"strategy": name, "dt": F.col("trade_date")}), path, ["strategy", "dt"], ["rank"])


def export_events_json(audit: DataFrame, path: str, start: str, end: str) -> None:
    t = F.col("timestamp")
    kept = audit.filter(t.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    kept.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def purge_expired(df: DataFrame, today: str, days: int, time: str) -> DataFrame:
    """Rows within the retention period."""
    return df.filter(F.to_date(time) >= F.date_sub(F.lit(today).cast("date"), days))


def purge_table(spark: SparkSession, path: str, today: str, days: int, time: str, partitions: list[str]) -> None:
    """Delete expired rows of a table: only partitions that hold any are rewritten.

    Partitions year and month are taken as those of ``time``, as ``with_period`` sets them: folders after the limit are not read.
    """
    last = dt.date.fromisoformat(today) - dt.timedelta(days)
    limit = F.lit(last)
    table = read_table(spark, path)
    old = table.filter(F.to_date(time) < limit)
    if "year" in partitions:
        this_year = F.col("year") == last.year
        if "month" in partitions:
            this_year = this_year & (F.col("month") <= last.month)
        old = old.filter((F.col("year") < last.year) | this_year)
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    stale = materialize(old.select(*partitions, folder.alias("_folder")).distinct())
    kept = materialize(only_partitions(table, stale, partitions).filter(F.to_date(time) >= limit))
    # A partition without any row left is not part of a dynamic overwrite; its folder, as the file
    # listing escapes it, is removed.
    gone = matched(stale, kept.select(*partitions).distinct(), partitions, "left_anti")
    jvm = spark.sparkContext._jvm
    for row in gone.select("_folder").distinct().toLocalIterator():  # one row per expired partition folder
        folder_path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row["_folder"]))
        folder_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder_path, True)
    write_table(kept, path, partitions)
