"""Reach counts by words of items against the closure, on cycles and chains."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import lineage
from tapeloom.operators.reach import components, numbered, reach_counts

SCHEMA = "source_id string, target_id string"


def brute(pairs):
    """node -> nodes that can be reached, itself left out."""
    out = {n: {b for a, b in pairs if a == n and a != b} for n in {x for p in pairs for x in p}}
    while True:
        new = {n: set(s).union(*[out[m] for m in s]) for n, s in out.items()}
        if new == out:
            return {n: s - {n} for n, s in out.items()}
        out = new


@pytest.mark.parametrize("pairs", [
    [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a"), ("d", "e"), ("e", "f"), ("f", "e"), ("y", "x"), ("x", "z")],
    [("a", "a"), ("a", "b"), ("a", "b")],
    [(f"n{a}", f"n{b}") for a, b in np.random.default_rng(4).integers(0, 14, (17, 2)).tolist()],
])
def test_counts_are_those_of_the_closure(spark, pairs):
    edges = spark.createDataFrame(pairs, SCHEMA)
    want = brute(pairs)
    held = {n: f"set{i % 3}" for i, n in enumerate(sorted(want))}
    items = lineage._as_items(edges).unionByName(spark.createDataFrame(
        [(n, "dataset", d, d) for n, d in held.items()], "node_id string, kind string, item string, near string"))
    got = {(r["node_id"], r["kind"]): r["total"] for r in reach_counts(edges, numbered(items)).collect()}
    expected = {(n, "node"): len(s) for n, s in want.items()} | {(n, "dataset"): len({held[m] for m in s}) for n, s in want.items()}
    assert got == {k: v for k, v in expected.items() if v}


def test_components_of_two_cycles(spark):
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("q", "b")], SCHEMA)
    assert dict(map(tuple, components(edges).collect())) == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e", "q": "q"}


def test_a_chain_needs_no_pairs(spark):
    chain = spark.range(12).select(F.format_string("n%02d", "id").alias("source_id"), F.format_string("n%02d", F.col("id") + 1).alias("target_id"))
    rows = {r["node_id"]: r for r in lineage.impact(chain).collect()}
    assert [rows[f"n{i:02d}"]["total_impact"] for i in range(13)] == list(range(12, -1, -1))
    assert [rows[f"n{i:02d}"]["total_dependencies"] for i in range(13)] == list(range(13))


def test_children_of_a_parent_share_words(spark):
    edges = spark.range(640).select(F.concat(F.lit("p"), F.col("id") % 10).alias("source_id"), F.concat(F.lit("c"), "id").alias("target_id"))
    words = numbered(lineage._as_items(edges)).join(edges.withColumnRenamed("target_id", "node_id"), "node_id")
    assert words.groupBy("source_id").agg(F.count_distinct("word").alias("n")).agg(F.max("n")).first()[0] <= 3
    assert reach_counts(edges.limit(0), numbered(lineage._as_items(edges.limit(0)))).count() == 0
