"""Exact grouped quantiles that never gather a large group in one task.

Groups up to a row limit are sorted by a window. The few larger ones go another way: a sketch per group gives a
narrow bracket around every wanted rank, exact counts below and inside the bracket say where
the rank lies, and only the values of that part are sorted. A poor sketch costs time, never
exactness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unpivot(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Long form (by..., name, _value) without nulls."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("_value")) for c in columns
    ])
    return df.select(*by, F.inline(pairs)).filter("_value is not null")


def matched(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the keys appear once."""
    renamed = other.withColumnsRenamed({c: f"_k_{c}" for c in keys})
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
    return df.join(renamed, on, how).drop(*[f"_k_{c}" for c in keys])


def exact_quantiles(
    df: DataFrame, by: list[str], columns: list[str], probs: list[float], accuracy: int = 10_000,
    direct_rows: int = 1_000_000,
) -> DataFrame:
    """One row per (by..., name) with the linear-interpolated quantiles ``q0, q1, ...``."""
    if "name" in by:
        raise ValueError("a grouping column may not be called 'name'")
    long = unpivot(df, by, columns)
    key = [*by, "name"]
    counts = df.groupBy(*by).agg(*[F.count(c).alias(f"_n{i}") for i, c in enumerate(columns)])
    sizes = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"_n{i}").alias("_n")) for i, c in enumerate(columns)])
    large = counts.select(*by, F.inline(sizes)).filter(F.col("_n") > direct_rows).select(*key)
    small_rows, large_rows = (matched(long, large, key, how) for how in ("left_anti", "left_semi"))
    return _sorted(small_rows, key, probs).unionByName(_bracketed(large_rows, key, probs, accuracy))


def wide_quantiles(df: DataFrame, by: list[str], columns: list[str], probs: list[float], **kw) -> DataFrame:
    """One row per ``by`` with columns ``_q<i>_<column>``."""
    names = [f"q{i}" for i in range(len(probs))]
    return exact_quantiles(df, by, columns, probs, **kw).groupBy(*by).agg(*[
        F.max(F.when(F.col("name") == c, F.col(q))).alias(f"_{q}_{c}") for c in columns for q in names
    ])


def _sorted(long: DataFrame, key: list[str], probs: list[float]) -> DataFrame:
    """Quantiles of groups that one task can sort: one shuffle, one sort."""
    group = Window.partitionBy(*key)
    ranked = long.withColumn("_rn", F.row_number().over(group.orderBy("_value")) - 1).withColumn("_n", F.count("*").over(group))

    def at(rank):
        return F.max(F.when(F.col("_rn") == rank, F.col("_value")))

    def rank(p: float):
        return F.lit(float(p)) * (F.col("_n") - 1)

    picked = ranked.groupBy(*key).agg(F.first("_n").alias("_n"), *[
        c for i, p in enumerate(probs) for c in (
            at(F.floor(rank(p))).alias(f"_a{i}"), at(F.least(F.floor(rank(p)) + 1, F.col("_n") - 1)).alias(f"_b{i}"),
        )
    ])

    def value(i: int, p: float):
        return F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (rank(p) - F.floor(rank(p)))

    return picked.select(*key, *[value(i, p).alias(f"q{i}") for i, p in enumerate(probs)])


def _bracketed(long: DataFrame, key: list[str], probs: list[float], accuracy: int) -> DataFrame:
    """Quantiles of large groups; the part that is sorted holds about ``6 / accuracy`` of a group."""
    slack = 3.0 / accuracy
    edges = [max(0.0, p - slack) for p in probs] + [min(1.0, p + slack) for p in probs]
    n_probs = len(probs)
    sketch = long.groupBy(*key).agg(
        F.count("*").alias("_n"), F.percentile_approx("_value", edges, accuracy).alias("_e")
    )
    wanted = F.array(*[
        F.struct(
            F.lit(i).alias("_i"), F.col("_e")[i].alias("_lo"), F.col("_e")[i + n_probs].alias("_hi"),
            (F.lit(float(p)) * (F.col("_n") - 1)).alias("_h"),
        )
        for i, p in enumerate(probs)
    ])
    cuts = sketch.select(*key, "_n", F.inline(wanted)).withColumn("_k", F.floor("_h"))
    cuts = cuts.withColumn("_k2", F.least(F.col("_k") + 1, F.col("_n") - 1))

    # One row per large group and probability; adaptive execution broadcasts it where it is small.
    part = F.when(F.col("_value") < F.col("_lo"), 0).when(F.col("_value") <= F.col("_hi"), 1).otherwise(2)
    placed = matched(long, cuts.select(*key, "_i", "_lo", "_hi"), key).select(*key, "_i", part.alias("_part"), "_value")
    sizes = placed.groupBy(*key, "_i").agg(
        F.count_if(F.col("_part") == 0).alias("_n0"), F.count_if(F.col("_part") == 1).alias("_n1")
    )

    def part_of(rank: str):
        return F.when(F.col(rank) < F.col("_n0"), 0).when(F.col(rank) < F.col("_n0") + F.col("_n1"), 1).otherwise(2)

    target = matched(cuts, sizes, [*key, "_i"]).select(
        *key, "_i", "_h", "_k", "_k2", "_n0", "_n1", "_lo", "_hi", part_of("_k").alias("_p1"), part_of("_k2").alias("_p2")
    )
    inside = (
        matched(long, target, key).withColumn("_part", part)
        .filter((F.col("_part") >= F.col("_p1")) & (F.col("_part") <= F.col("_p2")))
        .groupBy(*key, "_i", "_value").agg(
            F.count("*").alias("_c"),
            *[F.first(x).alias(x) for x in ("_h", "_k", "_k2", "_n0", "_n1", "_p1")],
        )
    )
    before = F.when(F.col("_p1") == 0, 0).when(F.col("_p1") == 1, F.col("_n0")).otherwise(F.col("_n0") + F.col("_n1"))
    upto = before + F.sum("_c").over(Window.partitionBy(*key, "_i").orderBy("_value"))
    ranked = inside.withColumn("_upto", upto)
    found = ranked.groupBy(*key, "_i").agg(
        F.min(F.when(F.col("_upto") > F.col("_k"), F.col("_value"))).alias("_v1"),
        F.min(F.when(F.col("_upto") > F.col("_k2"), F.col("_value"))).alias("_v2"),
        F.first(F.col("_h") - F.col("_k")).alias("_frac"),
    )
    value = F.col("_v1") + (F.col("_v2") - F.col("_v1")) * F.col("_frac")
    return found.groupBy(*key).agg(
        *[F.max(F.when(F.col("_i") == i, value)).alias(f"q{i}") for i in range(n_probs)]
    )
