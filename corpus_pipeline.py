"""From raw documents to training batches: each stage takes and returns documents, the last one batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import length_buckets, mixing, neardup, quality, toxicity
from tapeloom.llm.tables import materialize, read

TOXIC_FROM = 0.5
QUALITY_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC_FROM; learned from the labelled documents of the corpus."""
    model = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(model, docs["text"]) < TOXIC_FROM)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored QUALITY_FROM or better; word vectors come from the documents of this stage."""
    model = quality.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), corpus=docs)
    return docs.filter(quality.score(model, docs["text"]) >= QUALITY_FROM)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class."""
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per repeat that the mix takes; documents that it leaves out go."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their length bucket and batch."""
    return length_buckets.batches(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("quality", keep_quality), ("near_duplicates", one_of_each), ("mixing", mix_sources), ("packing", pack),
]
#: Learned scores and hashed signatures have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs


