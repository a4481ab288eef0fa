"""Session helpers: a local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

UTC_CONF = {"spark.sql.session.timeZone": "UTC"}


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tapeloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    for key, value in {**UTC_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a local one only for a local master without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder of the session."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings for what is planned and run inside."""
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def tasks_for(spark: SparkSession, rows: int, rows_per_task: int = 250_000) -> Iterator[None]:
    """Shuffles that are planned inside get a task per ``rows_per_task`` rows, so that the memory of a task does not grow with the table.

    Narrow rows shrink much in a shuffle: a partition of the default size would hold millions of them.
    """
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = str(max(number, -(-rows // rows_per_task)))
    with settings(spark, {"spark.sql.shuffle.partitions": wanted, "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"}):
        yield


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table in the shared folder.

    Used where one reduced frame feeds many branches: the frame is computed once, a lost
    executor re-reads a file and does not redo the scan and the windows, and the branches
    read only their columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
