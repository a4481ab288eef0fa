"""Merge of new rows into a keyed table: the new row wins."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tapeloom.functions.quantiles import matched
from tapeloom.operators.normalize import dedup_keep_last

BAR_KEY = ["exchange", "symbol", "interval", "datetime"]
STATEMENT_KEY = ["exchange", "symbol", "report_type", "report_date"]
FUNDAMENTAL_KEY = ["exchange", "symbol", "date"]


def upsert(old: DataFrame, new: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """``old`` without the keys of ``new``, plus the row of greatest load sequence per key of ``new``.

    ``old`` is unique by key, as every earlier upsert left it, so only an anti join on the
    keys (null equals null) is needed; a small batch is broadcast by adaptive execution and the table is not
    shuffled. A column that one side lacks is null there.
    """
    fresh = dedup_keep_last(new, keys, sequence)
    return matched(old, fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)
