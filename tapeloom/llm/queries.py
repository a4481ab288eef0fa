"""One thin query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import (
    conversations, fingerprints, length_buckets, mixing, neardup, neighbours, oracle, periodic_runs, quality, sentencepieces, token_packing, toxicity,
    urls, warc,
)
from tapeloom.llm.tables import held_out, read


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity.score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_report(read(spark, sf_dir, "documents"))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages against a replica with seeded faults."""
    records = warc.records(read(spark, sf_dir, "pages"))
    return warc.audit(records, warc.damaged_copy(records))


def op5_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_packing.pack(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), quality.score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op9_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_buckets.batches(read(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


def op11_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip_report(read(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with looped tails."""
    docs = read(spark, sf_dir, "documents")
    return periodic_runs.report(docs.withColumn("text", periodic_runs.looped(F.col("doc_id"), F.col("text"))))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with seeded faults."""
    return conversations.report(conversations.damaged(read(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_duplicates, op2_toxicity, op3_fingerprints, op4_warc_fixity, op5_token_packing, op6_mixing, op7_quality, op8_url_filter,
        op9_length_buckets, op10_neighbours, op11_sentencepieces, op12_periodic_runs, op13_conversation_repair,
    )
}
ORACLE: dict[str, str] = {"op4_warc_fixity": oracle.WARC, "op6_mixing": oracle.MIXING}
