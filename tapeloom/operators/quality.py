"""Quality rules as issue tables, rates and advice, for every series (or a whole table) at once.

An issue row: keys, rule_name, issue_type, severity, column, affected_records, total_records,
rate. All counts of a table come from one aggregate; quantiles and gaps need one pass each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tapeloom import fixed
from tapeloom.functions.carry import with_previous
from tapeloom.functions.columns import kept, price_order_broken
from tapeloom.functions.quantiles import matched, wide_quantiles
from tapeloom.operators.crosssection import group_percentiles
from tapeloom.operators.layers import bar_issues
from tapeloom.operators.profile import frame_summary
from tapeloom.operators.series import KEYS, returns

SERIES = ["exchange", "symbol"]
NUMERIC = ["open", "high", "low", "close", "volume", "turnover"]
ISSUE = ["rule_name", "issue_type", "severity", "column", "affected_records", "total_records", "rate"]


def with_keys(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Join statistics back; without keys they are a single row."""
    if keys:
        return matched(df, stats, keys)
    one = F.lit(1).alias("_one")
    return df.select("*", one).join(F.broadcast(stats.select("*", one)), "_one").drop("_one")


def _issue(rule: str, kind: str, column: Column, affected: Column, total: Column, severity) -> Column:
    rate = F.lit(1.0) - affected / total
    return F.struct(
        F.lit(rule).alias("rule_name"), F.lit(kind).alias("issue_type"), severity(rate).alias("severity"),
        column.alias("column"), affected.alias("affected_records"), total.alias("total_records"), rate.alias("rate"),
    )


def _critical_below(limit: float):
    return lambda rate: F.when(rate < limit, "critical").otherwise("poor")


def _checked(df: DataFrame, keys: list[str], checks: list[tuple]) -> DataFrame:
    """Issues of counted rules; ``checks`` = (rule, type, column or None, bad-row condition, severity)."""
    counted = df.groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.count_if(bad).alias(f"_b{i}") for i, (_, _, _, bad, _) in enumerate(checks)]
    )
    rows = F.array(*[
        _issue(rule, kind, F.lit(column).cast("string"), F.col(f"_b{i}"), F.col("_n"), severity)
        for i, (rule, kind, column, _, severity) in enumerate(checks)
    ])
    return counted.filter("_n > 0").select(*keys, F.inline(rows)).filter("affected_records > 0")


def _missing(columns: list[str]) -> list[tuple]:
    return [("missing_values", "completeness", c, F.col(c).isNull(), _critical_below(0.8)) for c in columns]


def _price_order() -> list[tuple]:
    bad = price_order_broken("open") | price_order_broken("close")
    return [("price_relationship", "accuracy", None, bad, _critical_below(0.9))]


def _negative(columns: list[str]) -> list[tuple]:
    return [("negative_values", "validity", c, F.col(c) < 0, _critical_below(0.9)) for c in columns]


def completeness(df: DataFrame, keys: list[str] = SERIES, columns: list[str] | None = None) -> DataFrame:
    return _checked(df, keys, _missing(columns or [c for c in df.columns if c not in keys]))


def accuracy(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    return _checked(df, keys, _price_order())


def negative(df: DataFrame, keys: list[str] = SERIES, columns: list[str] = NUMERIC) -> DataFrame:
    return _checked(df, keys, _negative(columns))


def custom_rule(df: DataFrame, name: str, kind: str, ok: Column, threshold: float = 0.95, keys: list[str] = SERIES) -> DataFrame:
    """A user's rule: ``ok`` must hold; critical below the threshold. A null counts as broken."""
    bad = ~F.coalesce(ok, F.lit(False))
    return _checked(df, keys, [(name, kind, None, bad, _critical_below(threshold))])


def consistency(df: DataFrame, keys: list[str] = SERIES, time: str = "datetime", chunk: str = "365 days") -> DataFrame:
    """Gaps off by more than half of the modal gap (ties: the smallest).

    Gaps are counted by length first, so the mode and the outliers come from that small table.
    ``chunk`` cuts a series for the search of the previous row: a year of daily bars by default,
    minutes for ticks.
    """
    before = with_previous(df.select(*keys, time), keys, [time], [time], chunk)
    gap = F.timestamp_diff("MICROSECOND", F.col(f"prev_{time}"), F.col(time))
    lengths = before.withColumn("_gap", gap).filter("_gap is not null").groupBy(*keys, "_gap").agg(F.count("*").alias("_c"))
    modal = F.min_by("_gap", F.struct(-F.col("_c"), "_gap"))
    modes = lengths.groupBy(*keys).agg(modal.alias("_mode"), F.sum("_c").alias("_n"))
    joined = with_keys(lengths, modes, keys)
    off = F.abs(F.col("_gap") - F.col("_mode")) > F.col("_mode") * 0.5
    counted = joined.filter("_mode > 0").groupBy(*keys, "_n").agg(F.coalesce(F.sum(F.when(off, F.col("_c"))), F.lit(0)).alias("_b"))
    issue = _issue("time_consistency", "consistency", F.lit(None).cast("string"), F.col("_b"), F.col("_n"),
                   lambda rate: F.when(rate < 0.95, "poor").otherwise("fair"))
    return counted.filter("_b > 0").select(*keys, F.inline(F.array(issue)))


def iqr_outliers(
    df: DataFrame, keys: list[str] = SERIES, columns: list[str] = NUMERIC, accuracy: int = 10_000, bounded: bool = True
) -> DataFrame:
    """Values beyond 1.5 interquartile ranges from the exact quartiles.

    Daily series are bounded by the calendar, so one percentile aggregate serves all columns; a whole
    table (no keys) goes through the bracketed form, and so do tick or minute series with ``bounded`` set to False.
    """
    if bounded and keys:
        bounds = group_percentiles(df, keys, columns, [0.25, 0.75])
    else:
        bounds = wide_quantiles(df, keys, columns, [0.25, 0.75], accuracy=accuracy)
    joined = with_keys(df.select(*keys, *columns), bounds, keys)

    def outside(c: str) -> Column:
        lo, hi = F.col(f"_q0_{c}"), F.col(f"_q1_{c}")
        return (F.col(c) < lo - (hi - lo) * 1.5) | (F.col(c) > hi + (hi - lo) * 1.5)

    fair_above = lambda rate: F.when(rate > 0.9, "fair").otherwise("poor")
    return _checked(joined, keys, [("outliers", "validity", c, outside(c), fair_above) for c in columns])


def empty_issue(df: DataFrame, keys: list[str]) -> DataFrame:
    """One critical issue when the table has no rows."""
    none = F.lit(None).cast("string")
    return df.agg(F.count("*").alias("_n")).filter("_n = 0").select(
        *[none.alias(k) for k in keys], F.lit("completeness_check").alias("rule_name"), F.lit("completeness").alias("issue_type"),
        F.lit("critical").alias("severity"), none.alias("column"), F.lit(0).cast("bigint").alias("affected_records"),
        F.lit(0).cast("bigint").alias("total_records"), F.lit(None).cast("double").alias("rate"),
    )


def validate(df: DataFrame, keys: list[str] = SERIES, columns: list[str] | None = None, bounded: bool = True) -> DataFrame:
    """All rules of a bar table as one issue table; for series of any length set ``bounded`` to False."""
    columns = columns or ["datetime", *NUMERIC]
    parts = [
        _checked(df, keys, [*_missing(columns), *_price_order(), *_negative(NUMERIC)]),
        consistency(df, keys), iqr_outliers(df, keys, bounded=bounded), empty_issue(df, keys),
    ]
    return reduce(DataFrame.unionByName, parts)


def weighted_score(issues: DataFrame, df: DataFrame, weights: dict[str, float], keys: list[str] = SERIES) -> DataFrame:
    """Weighted mean of the rates of the named rules for every series; a rule has its lowest rate, or 1 without an issue."""
    rates = [F.min(F.when(F.col("rule_name") == rule, F.col("rate"))).alias(f"_r{i}") for i, rule in enumerate(weights)]
    joined = matched(df.groupBy(*keys).agg(F.count("*").alias("total_records")), issues.groupBy(*keys).agg(*rates), keys, "left")
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"_r{i}"), F.lit(1.0)) * float(w) for i, w in enumerate(weights.values())])
    return joined.select(*keys, "total_records", (total / float(sum(weights.values()))).alias("weighted_score"))


TYPES = ("completeness", "accuracy", "consistency", "validity")


def metrics(issues: DataFrame, df: DataFrame, keys: list[str] = SERIES, corrected: bool = False) -> DataFrame:
    """Rate per rule type, overall score and level of every series.

    A rate is 1 - affected / rows. By default a type without issues scores 0 once another
    type has one, and scores of 0 or less stay out of the mean; ``corrected`` gives a clean
    type 1 and floors a rate at 0.
    """
    totals = df.groupBy(*keys).agg(F.count("*").alias("total_records"))
    sums = issues.groupBy(*keys).agg(
        F.count("*").alias("_issues"),
        *[F.sum(F.when(F.col("issue_type") == t, F.col("affected_records"))).alias(f"_{t}") for t in TYPES],
    )
    joined = matched(totals, sums, keys, "left") if keys else with_keys(totals, sums, keys)
    clean = F.coalesce(F.col("_issues"), F.lit(0)) == 0

    def rate(t: str) -> Column:
        raw = F.lit(1.0) - F.col(f"_{t}") / F.col("total_records")
        if corrected:
            return F.greatest(F.coalesce(raw, F.lit(1.0)), F.lit(0.0))
        return F.when(clean, 1.0).otherwise(F.coalesce(raw, F.lit(0.0)))

    rated = joined.select(*keys, "total_records", *[rate(t).alias(t) for t in TYPES])
    counted = [F.when((F.col(t) > 0) | F.lit(corrected), F.col(t)) for t in TYPES]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in counted])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in counted])
    s = F.col("overall_score")
    level = (
        F.when(s >= 0.95, "excellent").when(s >= 0.85, "good").when(s >= 0.70, "fair").when(s >= 0.50, "poor")
        .otherwise("critical")
    )
    return rated.withColumn("overall_score", F.try_divide(total, n)).withColumn("quality_level", level)


def recommend(issues: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Advice per series by the severities and types of its issues."""
    def has(column: str, value: str) -> Column:
        return F.count_if(F.col(column) == value) > 0

    flags = issues.groupBy(*keys).agg(
        has("severity", "critical").alias("_c"), has("severity", "poor").alias("_p"),
        has("issue_type", "completeness").alias("_m"), has("issue_type", "accuracy").alias("_a"),
    )
    advice = kept(
        (F.col("_c"), fixed.ADVICE_CRITICAL), (F.col("_p"), fixed.ADVICE_POOR), (F.col("_m"), fixed.ADVICE_COMPLETENESS),
        (F.col("_a"), fixed.ADVICE_ACCURACY),
    )
    return flags.select(*keys, advice.alias("recommendations"))


def _scored(df: DataFrame, issues: Column) -> DataFrame:
    out = df.withColumn("issues", issues)
    return out.withColumns({"quality_score": F.lit(1.0) - F.size("issues") / 10.0, "is_valid": F.size("issues") == 0})


def score_ods_bars(df: DataFrame) -> DataFrame:
    return _scored(df, bar_issues())


def score_dwd_bars(df: DataFrame) -> DataFrame:
    return _scored(df, kept((F.col("vwap") <= 0, fixed.BAD_VWAP), (F.col("amount") <= 0, fixed.BAD_TURNOVER)))


def score_dws_adjusted(df: DataFrame) -> DataFrame:
    return _scored(df, kept((F.col("qfq_factor") <= 0, fixed.BAD_QFQ), (F.col("hfq_factor") <= 0, fixed.BAD_HFQ)))


def check_frame(df: DataFrame, data_type: str) -> DataFrame:
    """One row: emptiness, missing share, duplicates, non-positive closes or ratios, and the verdict."""
    column = {"price": "close", "fundamental": "pe_ttm"}.get(data_type)
    checked = column if column in df.columns else None
    bad = F.count_if(F.col(checked) <= 0) if checked else F.lit(0)
    low = df.agg(bad.alias("non_positive")).withColumn("_k", F.lit(1))
    base = frame_summary(df, data_type).withColumn("_k", F.lit(1)).join(low, "_k")
    return base.select(
        "data_type", "total_records", (F.col("missing_ratio") > 0.1).alias("many_missing"),
        (F.col("duplicate_count") > 0).alias("has_duplicates"), "non_positive",
        ((F.col("total_records") > 0) & (F.col("non_positive") == 0)).alias("passed"),
    )


def anomalies(df: DataFrame, keys=KEYS, sigmas: float = 3.0, high: float = 5.0) -> DataFrame:
    """Rows whose return lies more than ``sigmas`` deviations from the series mean."""
    series = Window.partitionBy(*keys)
    rated = returns(df, out="change_rate", keys=keys).withColumns({
        "_m": F.avg("change_rate").over(series), "_s": F.stddev_samp("change_rate").over(series),
    })
    out = rated.filter(F.abs(F.col("change_rate") - F.col("_m")) > sigmas * F.col("_s"))
    severity = F.when(F.abs("change_rate") > high * F.col("_s"), "high").otherwise("medium")
    return out.select(*keys, "datetime", F.lit("price_spike").alias("type"), F.col("close").alias("value"), "change_rate",
                      severity.alias("severity"))


def schema_check(df: DataFrame, expected: StructType) -> DataFrame:
    """Missing fields are errors; extra fields and other types are warnings; with the rows concerned."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in expected}
    found = [(c, "missing_field", "error") for c in want if c not in have]
    found += [(c, "extra_field", "warning") for c in have if c not in want]
    found += [(c, "type_mismatch", "warning") for c in want if c in have and have[c] != want[c]]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("issue"), F.lit(s).alias("severity")) for c, k, s in found])
    counted = df.agg(F.count("*").alias("total_records"))
    if not found:
        return counted.selectExpr("string(null) column", "string(null) issue", "string(null) severity", "total_records").limit(0)
    return counted.select(F.inline(rows), "total_records")
