"""Lineage over an edge table: neighbours, closure, paths, impact, edges of a dataset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom import fixed
from tapeloom.functions.columns import kept
from tapeloom.operators.reach import numbered, reach_counts
from tapeloom.session import materialize, scratch_path, tasks_for


def neighbors(edges: DataFrame) -> DataFrame:
    """(node_id, direction, neighbor) for direct parents and children."""
    up = edges.select(F.col("target_id").alias("node_id"), F.lit("upstream").alias("direction"), F.col("source_id").alias("neighbor"))
    down = edges.select(F.col("source_id").alias("node_id"), F.lit("downstream").alias("direction"), F.col("target_id").alias("neighbor"))
    return up.union(down).distinct()


def closure(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root, node) for everything reachable from each root; a root is never its own descendant.

    With a table of roots (node_id) only their descendants are followed, one level per round;
    ancestors come from the reversed edges. Without one every node is a root and reach doubles per
    round (pairs join pairs), so a chain of n edges takes log n rounds. Rounds end when one finds
    nothing new, which also ends cycles; each is written to the shared folder, so the plan stays short.
    """
    steps = materialize(edges.select(F.col("source_id").alias("root"), F.col("target_id").alias("node")).filter("root <> node").distinct())
    if roots is None:
        known = new = steps
        while True:
            # Only pairs with a new half can be new.
            grown = _onward(new, known).union(_onward(known, new)).filter("root <> node")
            new = materialize(grown.distinct().join(known, ["root", "node"], "left_anti"))
            if new.isEmpty():
                return known
            known = materialize(known.union(new))
    first = steps.join(roots.select(F.col("node_id").alias("root")).distinct(), "root", "left_semi")
    return _by_levels(first, lambda level: _onward(level, steps).filter("root <> node").distinct(), ["root", "node"])


def _onward(left: DataFrame, right: DataFrame) -> DataFrame:
    """(root, node): the pairs of ``left`` lengthened by those of ``right``."""
    return left.join(right.select(F.col("root").alias("node"), F.col("node").alias("_to")), "node").select("root", F.col("_to").alias("node"))


def _by_levels(first: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str] | None = None) -> DataFrame:
    """``first`` and all that ``step`` makes of each level, until a level is empty; with ``keys`` only rows that are new go on.

    Every level is a folder of one table, so the plan of the result is one scan, however many levels there are.
    """
    spark, path = first.sparkSession, scratch_path(first.sparkSession, "levels")
    schema, number, level = first.schema, 0, first
    while True:
        level.write.parquet(f"{path}/depth={number}")
        level = spark.read.schema(schema).parquet(f"{path}/depth={number}")
        known = spark.read.schema(schema).parquet(path).select(*schema.names)
        if level.isEmpty():
            return known
        level = step(level)
        if keys is not None:
            level = level.join(known, keys, "left_anti")
        number += 1


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node_id) of the seeds and all nodes that can be reached from any of them; no pairs are kept."""
    steps = materialize(edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("_to")).distinct())
    return _by_levels(
        seeds.select("node_id").distinct(), lambda level: level.join(steps, "node_id").select(F.col("_to").alias("node_id")).distinct(), ["node_id"])


def paths(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """All simple paths from the nodes of ``sources`` to those of ``targets``, as arrays.

    Only edges into nodes from which a target can be reached are followed, so branches that end elsewhere are never
    walked. A path grows until no simple path is left to extend; on dense graphs their number is exponential.
    """
    reversed_ = edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    useful = materialize(reachable(reversed_, targets))
    steps = useful_steps(edges, useful)
    first = sources.select("node_id").distinct().join(useful, "node_id", "left_semi").select(F.col("node_id").alias("end"), F.array("node_id").alias("path"))

    def grow(level: DataFrame) -> DataFrame:
        grown = level.join(steps, F.col("end") == F.col("source_id")).filter(~F.array_contains("path", F.col("target_id")))
        return grown.select(F.col("target_id").alias("end"), F.concat("path", F.array("target_id")).alias("path"))

    found = _by_levels(first, grow).join(targets.select(F.col("node_id").alias("end")).distinct(), "end", "left_semi")
    return found.select(F.element_at("path", 1).alias("source_id"), F.col("end").alias("target_id"), "path")


def useful_steps(edges: DataFrame, useful: DataFrame) -> DataFrame:
    """The edges into nodes of ``useful``, once each."""
    return materialize(
        edges.select("source_id", "target_id").distinct().join(useful.select(F.col("node_id").alias("target_id")), "target_id", "left_semi")
        .select("source_id", "target_id"))


def impact(edges: DataFrame) -> DataFrame:
    """Direct and total counts up and down per node; totals are counted on sets of nodes (``reach``), not on pairs."""
    with tasks_for(edges.sparkSession, edges.count()):
        own = numbered(_as_items(edges))
        return materialize(_impact(edges, own, reach_counts(edges, own)))


def _impact(edges: DataFrame, own: DataFrame, below: DataFrame) -> DataFrame:
    """impact with the numbered nodes and the counts (node_id, kind, total) of what lies below each node at hand."""
    step = edges.select("source_id", "target_id").distinct()
    above = reach_counts(edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")), own)
    parts = [
        step.groupBy(F.col("source_id").alias("node_id")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("direct_impact")),
        step.groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("dependencies")),
        below.filter("kind = 'node'").select("node_id", F.col("total").alias("n"), F.lit("total_impact").alias("kind")),
        above.select("node_id", F.col("total").alias("n"), F.lit("total_dependencies").alias("kind")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    kinds = ("direct_impact", "total_impact", "dependencies", "total_dependencies")
    return rows.groupBy("node_id").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds])


def _as_items(edges: DataFrame) -> DataFrame:
    """Every node as an item of itself, near the other children of its parent."""
    parents = edges.groupBy(F.col("target_id").alias("node_id")).agg(F.min("source_id").alias("near"))
    nodes = edges.select(F.col("source_id").alias("node_id")).union(edges.select("target_id")).distinct()
    return nodes.join(parents, "node_id", "left").select("node_id", F.lit("node").alias("kind"), F.col("node_id").alias("item"), "near")


def advise(impacts: DataFrame) -> DataFrame:
    """Advice texts for wide impact, many dependencies, no use."""
    return impacts.withColumn("recommendations", kept(
        (F.col("total_impact") > 10, fixed.ADVICE_WIDE_IMPACT),
        (F.col("total_dependencies") > 5, fixed.ADVICE_MANY_DEPENDENCIES),
        (F.col("direct_impact") == 0, fixed.ADVICE_UNUSED),
    ))


def affected_datasets(nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """(node_id, dataset_id): datasets with a node reachable from the node."""
    hits = reach.join(nodes.select(F.col("node_id").alias("node"), "dataset_id").distinct(), "node")
    return hits.select(F.col("root").alias("node_id"), "dataset_id").distinct()


def dataset_impact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Impact of each dataset through its first store node, with the number of affected datasets."""
    stores = nodes.filter("node_type = 'store'").groupBy("dataset_id").agg(F.min("node_id").alias("node_id"))
    held = nodes.filter("dataset_id is not null").select("node_id", F.lit("dataset").alias("kind"), F.col("dataset_id").alias("item"), F.col("dataset_id").alias("near"))
    with tasks_for(edges.sparkSession, edges.count() + nodes.count()):
        own = numbered(_as_items(edges).unionByName(held))
        below = materialize(reach_counts(edges, own))
        counts = below.filter("kind = 'dataset'").select("node_id", F.col("total").alias("affected_datasets"))
        zeros = {c: 0 for c in ("direct_impact", "total_impact", "dependencies", "total_dependencies", "affected_datasets")}
        joined = stores.join(_impact(edges, own.filter("kind = 'node'"), below), "node_id", "left").join(counts, "node_id", "left").na.fill(zeros)
        return materialize(advise(joined))


def provider_impact(datasets: DataFrame) -> DataFrame:
    """Datasets per provider (dataset_id, provider), with advice."""
    counted = datasets.groupBy("provider").agg(F.count_distinct("dataset_id").alias("total_impact"))
    return counted.withColumn("recommendations", kept(
        (F.col("total_impact") > 20, fixed.ADVICE_PROVIDER_WIDE), (F.col("total_impact") == 0, fixed.ADVICE_PROVIDER_UNUSED),
    ))


def datasets_of_provider(datasets: DataFrame, text: str) -> DataFrame:
    """Datasets whose provider name contains a text."""
    return datasets.filter(F.contains("provider", F.lit(text)))


def chain_edges(datasets: DataFrame) -> DataFrame:
    """Source, provider, service, store chain of each (symbol, provider) dataset as edges."""
    source, provider = F.concat(F.lit("source_"), "symbol"), F.concat(F.lit("provider_"), "provider")
    service, store = F.concat(F.lit("service_bars_"), "symbol"), F.concat(F.lit("store_bars_"), "symbol")
    chain = [source, provider, service, store]
    links = [
        F.struct(F.lit(i + 1).alias("step"), a.alias("source_id"), b.alias("target_id"))
        for i, (a, b) in enumerate(zip(chain, chain[1:]))
    ]
    return datasets.select("symbol", "provider", F.inline(F.array(*links)))


def lineage_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and outgoing edges per dataset."""
    per_node = edges.groupBy("source_id").agg(F.count("*").alias("_e"))
    joined = nodes.join(per_node, nodes["node_id"] == per_node["source_id"], "left")
    return joined.groupBy("dataset_id").agg(
        F.count("*").alias("nodes_count"), F.coalesce(F.sum("_e"), F.lit(0)).alias("edges_count")
    )
