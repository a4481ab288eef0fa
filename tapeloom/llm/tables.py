"""Reading the given tables and small glue shared by the operators."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.session import materialize  # noqa: F401  (re-exported)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows that never teach a label: crc32 of the id as text is divisible by five."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(True))


def sub_seed(seed: int, name: str) -> int:
    """A seed of its own for each use."""
    return zlib.crc32(f"{seed}/{name}".encode())


def fresh(prefix: str, taken: list[str]) -> str:
    """A column name that no given column has."""
    name = prefix
    while name.lower() in {x.lower() for x in taken}:
        name = f"{prefix}_{uuid.uuid4().hex[:6]}"
    return name


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))
