"""Structured Streaming jobs over arriving bar and metric files.

Sources are file streams; with the ``availableNow`` trigger a job takes everything that has
arrived and stops, with a processing-time trigger it keeps running.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tapeloom.functions.quantiles import matched
from tapeloom.operators import metrics as metric_ops
from tapeloom.operators.normalize import dedup_keep_last
from tapeloom.operators.resample import MINUTES, resample
from tapeloom.operators.upsert import BAR_KEY
from tapeloom.sinks import tables as sinks
from tapeloom.sources.scans import recent_rows

TICK_SERIES = ["exchange", "symbol"]


def file_stream(spark: SparkSession, path: str, schema: StructType | str, glob: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> StreamingQuery:
    """Write everything available to a file sink and stop."""
    query = (
        df.writeStream.format(fmt).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def for_each_batch(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    query = (
        df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def event_time(stream: DataFrame, time: str = "datetime") -> DataFrame:
    """A watermark needs a timestamp with a zone; bar times are UTC."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def dedup(stream: DataFrame, keys: list[str], time: str = "datetime", delay: str = "10 minutes") -> DataFrame:
    """Collapse exact repeats of (keys, time) that arrive within the delay.

    Which row of a key stays is left to chance: ``keys`` must hold every column by which rows of one time can differ.
    """
    timed = event_time(stream, time).withWatermark(time, delay)
    return timed.dropDuplicatesWithinWatermark([*keys, time]).withColumn(time, F.col(time).cast("timestamp_ntz"))


def resample_stream(stream: DataFrame, to: str = "5m", delay: str = "10 minutes") -> DataFrame:
    """OHLCV buckets in append mode: a bucket comes out once the watermark has passed its end.

    Rows later than ``delay`` are dropped by the watermark. When a stream ends, ``open_buckets`` gives the rest.
    """
    ts = F.col("datetime")
    grouped = event_time(stream).withWatermark("datetime", delay).groupBy(*TICK_SERIES, F.window("datetime", MINUTES[to]))
    bars = grouped.agg(
        F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close"),
        F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"),
    )
    return bars.select(*TICK_SERIES, F.col("window.start").cast("timestamp_ntz").alias("datetime"), "open", "high", "low", "close", "volume", "turnover")


def open_buckets(bars: DataFrame, written: DataFrame, to: str = "5m") -> DataFrame:
    """The buckets of all arrived bars that a stopped stream has not put out yet, by a batch pass over the tail.

    Only bars from the last written bucket of any series on are read again.
    """
    last = written.agg(F.max("datetime").alias("_last"))
    tail = bars.join(last).filter("_last is null or datetime >= _last").drop("_last")
    whole = resample(tail, to).select(*written.columns)
    return matched(whole, written.select(*TICK_SERIES, "datetime"), [*TICK_SERIES, "datetime"], "left_anti")


def latest_stream(stream: DataFrame) -> DataFrame:
    """Newest bar per series, for update mode."""
    newest = F.max_by(F.struct("datetime", "open", "high", "low", "close", "volume"), "datetime")
    return stream.groupBy(*TICK_SERIES).agg(newest.alias("b")).select(*TICK_SERIES, "b.*")


def upsert_batches(
    stream: DataFrame, path: str, checkpoint: str, partitions: list[str], keys: list[str] = BAR_KEY, sequence: list[str] = ("seq",)
) -> StreamingQuery:
    """Merge every micro-batch into a table; the row of greatest ``sequence`` wins, a repeated batch writes the same rows again."""
    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            sinks.upsert_table(batch.sparkSession, path, batch, keys, partitions, list(sequence), cluster=["symbol", "datetime"])

    return for_each_batch(stream, merge, checkpoint)


def high_water(df: DataFrame) -> DataFrame:
    """The newest time of every series."""
    return df.groupBy(*TICK_SERIES).agg(F.max("datetime").alias("datetime"))


def upsert_newer(
    stream: DataFrame, path: str, checkpoint: str, partitions: list[str], cursor: str, cold_rows: int = 100, sequence: list[str] = ("seq",)
) -> StreamingQuery:
    """Append to a table what is newer than its stored maximum per series, and move the stored maximum on.

    The cursor is a table of one row per series beside the data; it is built from the data once if it is missing. Of a series that it does not
    know, the last ``cold_rows`` rows of the batch are taken. On a repeated time the row of greatest ``sequence`` wins. The data are written
    before the cursor: a batch that runs again before the cursor moved merges the same rows by key, one that runs
    again afterwards finds nothing newer.
    """
    spark = stream.sparkSession
    if not sinks.table_exists(spark, cursor) and sinks.table_exists(spark, path):
        sinks.write_table(high_water(sinks.read_table(spark, path)), cursor, ["exchange"])

    def take(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if sinks.table_exists(spark, cursor):
            known = sinks.read_table(spark, cursor).select(*TICK_SERIES, F.col("datetime").alias("_stored"))
        else:
            known = spark.createDataFrame([], "exchange string, symbol string, _stored timestamp_ntz")
        held = matched(dedup_keep_last(batch, BAR_KEY, list(sequence)), known, TICK_SERIES, "left")
        newer = held.filter("datetime > _stored").drop("_stored")
        first = cold_start(held.filter("_stored is null").drop("_stored"), cold_rows)
        taken = sinks.materialize(newer.unionByName(first))
        if not taken.isEmpty():
            sinks.upsert_table(spark, path, taken, BAR_KEY, partitions, list(sequence), cluster=["symbol", "datetime"])
            sinks.upsert_table(spark, cursor, high_water(taken), TICK_SERIES, ["exchange"], ["datetime"])

    return for_each_batch(stream, take, checkpoint)


def cold_start(history: DataFrame, rows: int = 100) -> DataFrame:
    """What a new table begins with: the last rows of every series."""
    return recent_rows(history, rows)


def upsert_latest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of the newest bar per series, partitioned by exchange.

    In update mode a batch holds only the series that changed; they are merged by key.
    """

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            sinks.upsert_table(batch.sparkSession, path, batch, TICK_SERIES, ["exchange"], ["datetime"])

    return for_each_batch(latest_stream(stream), merge, checkpoint, "update")


def alert_batches(stream: DataFrame, rules: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rule changes per micro-batch, with the last state of every rule kept between batches.

    The state is one row per rule, written per batch, so a batch that runs twice starts from
    the same state. Changes inside a batch are found over time chunks, so no rule's points
    are gathered in one task.
    """

    def judge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        judged = batch.join(rules, "name").withColumn("breach", metric_ops.breached())
        rank = F.struct("timestamp", "event_id")
        edge = judged.groupBy("rule").agg(
            F.max_by("breach", rank).alias("last"), F.min_by("breach", rank).alias("first"), F.min_by("event_id", rank).alias("first_id")
        )
        columns = "rule string, breach boolean"
        before = spark.read.schema(columns).parquet(f"{path}/state/batch={number - 1}") if number else spark.createDataFrame([], columns)
        before = before.withColumnRenamed("breach", "held")
        # A rule broken before the batch does not fire again on the batch's first point; one
        # that was broken and starts unbroken is resolved there.
        changes = metric_ops.transitions(batch, rules).join(edge.select("rule", "first_id"), "rule").join(before, "rule", "left")
        again = (F.col("event_id") == F.col("first_id")) & F.coalesce("held", F.lit(False)) & (F.col("change") == "fired")
        kept = changes.filter(~again).select("rule", "timestamp", "event_id", "value", "change", "level")
        ended = edge.join(before, "rule").filter("held and not first").select("rule", F.col("first_id").alias("event_id"))
        resolved = judged.join(ended, ["rule", "event_id"]).select(
            "rule", "timestamp", "event_id", "value", F.lit("resolved").alias("change"), "level")
        kept.union(resolved).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        after = before.join(edge, "rule", "full").select("rule", F.coalesce("last", "held").alias("breach"))
        after.write.mode("overwrite").parquet(f"{path}/state/batch={number}")
        batch.unpersist()

    return for_each_batch(stream, judge, checkpoint)
