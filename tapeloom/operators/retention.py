"""Retention and compliance over asset tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom import fixed


def policy_table(spark: SparkSession, days: dict[str, int | None] | None = None) -> DataFrame:
    """(policy_id, days): a handful of rows; null days = kept for ever."""
    return spark.createDataFrame(list((days or fixed.RETENTION_DAYS).items()), "policy_id string, days int")


def with_expiry(assets: DataFrame, policies: DataFrame, now: str) -> DataFrame:
    """Expiry date, whether the asset is expired, and the compliance status, per asset."""
    t = F.lit(now).cast("timestamp_ntz")
    joined = assets.join(policies.withColumn("known", F.lit(True)), "policy_id", "left")
    expires = F.col("created_at") + F.make_dt_interval(F.col("days"))
    out = joined.withColumn("expires_at", expires)
    out = out.withColumn("is_expired", F.coalesce(F.col("expires_at") < t, F.lit(False)))
    status = F.when(F.col("known").isNull(), "failed").when(F.col("is_expired"), "warning").otherwise("passed")
    return out.withColumn("status", status).drop("known", "days")


def compliance_summary(checks: DataFrame) -> DataFrame:
    s = F.col("status")
    return checks.agg(
        F.count("*").alias("total_checks"), F.count_if(s == "passed").alias("passed_checks"),
        F.count_if(s == "failed").alias("failed_checks"), F.count_if(s == "warning").alias("warning_checks"),
    )
