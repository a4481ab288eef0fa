"""Layer programs: landed rows through the clean to the derived layer, with counts per layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tapeloom.operators import layers


def bar_layers(bars: DataFrame, source: str, factors: DataFrame | None = None, at=None) -> dict[str, DataFrame]:
    """The four bar tables of the lake, lazily; all symbols at once."""
    ods = layers.ods_bars(bars, source, at)
    dwd = layers.dwd_bars(ods, at=at)
    return {
        "ods_bars": ods, "dwd_bars": dwd, "dws_adjusted": layers.dws_adjusted(dwd, factors, at),
        "dws_factors": layers.dws_flow_factors(dwd, at),
    }


def financial_layers(ods: DataFrame, fundamentals: DataFrame, at=None) -> dict[str, DataFrame]:
    dwd = layers.dwd_financial(ods, at=at)
    return {"ods_financial": ods, "dwd_financial": dwd, "dws_merged": layers.dws_merged(dwd, fundamentals, at)}


def observed(frames: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, Observation]]:
    """The same frames, each counting its rows while it is written."""
    watch = {name: Observation(name) for name in frames}
    return {n: df.observe(watch[n], F.count(F.lit(1)).alias("rows")) for n, df in frames.items()}, watch


def layer_counts(frames: dict[str, DataFrame], keys=("exchange", "symbol")) -> DataFrame:
    """Rows per layer and symbol."""
    out = None
    for name, df in frames.items():
        part = df.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.lit(name).alias("layer"), "n")
        out = part if out is None else out.union(part)
    return out


def layer_summary(bars: DataFrame, factors: DataFrame, ods_fin: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Rows and date range of every layer for all symbols at once; date ranges for bars only."""
    parts = []
    for name, df in bar_layers(bars, "lake", factors).items():
        parts.append(df.select("exchange", "symbol", F.lit(name).alias("layer"), F.to_date("datetime").alias("d")))
    fin = financial_layers(ods_fin, fundamentals)
    none = F.lit(None).cast("date")
    for name, df in (("ods_financial", ods_fin), ("dws_merged", fin["dws_merged"]), ("ods_fundamental", fundamentals)):
        parts.append(df.select("exchange", "symbol", F.lit(name), none))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows.groupBy("exchange", "symbol", "layer").agg(
        F.count("*").alias("n"), F.min("d").alias("first_date"), F.max("d").alias("last_date")
    )


def batch_status(symbols: DataFrame, frames: dict[str, DataFrame]) -> DataFrame:
    """Status of every asked symbol after one job over all of them."""
    totals = layer_counts(frames, keys=("symbol",)).groupBy("symbol").agg(F.sum("n").alias("total_rows"))
    joined = symbols.join(totals, "symbol", "left").withColumn("total_rows", F.coalesce("total_rows", F.lit(0)))
    return joined.withColumn("status", F.when(F.col("total_rows") > 0, "success").otherwise("no_data"))
