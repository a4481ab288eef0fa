"""Previous-row access for series that are too long for one task.

A tick or metric series may hold a third of all rows. It is cut into time chunks; inside a
chunk a window finds the previous row, and the first row of a chunk takes the last row of
the chunk before, from a table that holds one row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions.quantiles import matched


def last_known(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], chunk: str = "30 days",
) -> DataFrame:
    """Every column of ``columns`` filled with its last value that is not null, up to the row, in (keys, order).

    ``order[0]`` is the time column; equal order ranks fill from each other in no fixed order. A series is cut
    into time chunks; what a chunk inherits comes from a table of one row per chunk.
    """
    rank = F.struct(*order)
    chunked = df.withColumn("_chunk", F.window(F.col(order[0]).cast("timestamp"), chunk)["start"])
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.withColumns({c: F.last(c, ignorenulls=True).over(within) for c in columns})
    tails = chunked.groupBy(*keys, "_chunk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(f"_t{i}") for i, c in enumerate(columns)])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select(*keys, "_chunk", *[F.last(f"_t{i}", ignorenulls=True).over(before).alias(f"_c{i}") for i in range(len(columns))])
    joined = matched(local, tails, [*keys, "_chunk"], "left")
    return joined.withColumns({c: F.coalesce(c, f"_c{i}") for i, c in enumerate(columns)}).select(*df.columns)


def in_blocks(
    df: DataFrame, keys: list[str], order: list[str], look_back: int, compute: Callable[[DataFrame, list[str]], DataFrame],
    block_rows: int = 100_000, chunk: str = "1 day",
) -> DataFrame:
    """``compute(rows, keys)`` for windows of at most ``look_back`` rows before the current one, on series of any length.

    ``compute`` gets the keys to partition its windows by, and must keep the columns it does not know. Rows are numbered per series
    (in time chunks, with the counts of earlier chunks from a table of one row per chunk) and cut into blocks of
    ``block_rows``; the last ``look_back`` rows of a block stand once more before the next block, where they only serve as
    its past. No task holds more than block_rows + look_back rows of a series. The order must be total within a key.
    """
    size = max(block_rows, look_back)
    chunked = df.withColumn("_chunk", F.window(F.col(order[0]).cast("timestamp"), chunk)["start"])
    counts = chunked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order)) - 1
    placed = matched(chunked.withColumn("_local", local), starts, [*keys, "_chunk"], "left")
    place = F.col("_start") + F.col("_local")
    numbered = placed.withColumn("_block", F.floor(place / size)).withColumn("_from_end", size - place % size)
    twice = F.when(F.col("_from_end") <= look_back, F.array(F.col("_block"), F.col("_block") + 1)).otherwise(F.array(F.col("_block")))
    spread = numbered.withColumn("_own", F.col("_block")).withColumn("_block", F.explode(twice)).drop("_chunk", "_start", "_local", "_from_end")
    return compute(spread, [*keys, "_block"]).filter("_own = _block").drop("_own", "_block")


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], chunk: str = "1 minute",
    prefix: str = "prev_",
) -> DataFrame:
    """Add ``prev_<c>`` for every column: its value on the row before in (keys, order).

    ``order[0]`` is the time column; the order must be total within a key.
    """
    row, rank = F.struct(*columns), F.struct(*order)
    chunked = df.withColumn("_chunk", F.window(order[0], chunk)["start"])
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = chunked.withColumn("_prev", F.lag(row).over(within))
    tails = chunked.groupBy(*keys, "_chunk").agg(F.max_by(row, rank).alias("_tail"))
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    tails = tails.select(*keys, "_chunk", F.lag("_tail").over(by_chunk).alias("_carried"))
    joined = matched(local, tails, [*keys, "_chunk"], "left")
    prev = F.coalesce("_prev", "_carried")
    return joined.select(*df.columns, *[prev[c].alias(f"{prefix}{c}") for c in columns])
