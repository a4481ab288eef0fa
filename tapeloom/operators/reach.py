"""Counts of what can be reached in a graph, without a table of (root, node) pairs.

What a node reaches is a set of numbered items, kept as words of 64 items each. Nodes finish from the end of the graph: a
node whose targets are all finished takes the union of their words, so every edge passes on every word once. Where only cycles and
nodes before them are left, the members of a cycle become one component and the rest finishes in the same way. A round is
joins and a combinable bit_or; its tables are written to the shared folder. There are as many rounds as the longest path has edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.session import materialize, scratch_path

_WORDS = "comp string, kind string, word bigint, bits bigint"


def numbered(items: DataFrame) -> DataFrame:
    """(node_id, kind, word, bits) of items (node_id, kind, item, near): one bit per item, items with a like ``near`` in the same words."""
    order = items.groupBy("kind", "item").agg(F.min("near").alias("near")).orderBy("kind", "near", "item")
    places = materialize(order.select("kind", "item", F.monotonically_increasing_id().alias("at")))
    bit = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    return materialize(items.select("node_id", "kind", "item").distinct().join(places, ["kind", "item"]).select(
        "node_id", "kind", F.shiftright("at", 6).alias("word"), bit.alias("bits")))


def _levels(steps: DataFrame, open_: DataFrame, ready: DataFrame, own: DataFrame, down: str, leaves_have_edges: bool = False) -> DataFrame:
    """Finish components level by level until none is ready; the edges that stay open are returned.

    ``down`` gathers the words of finished components without their own items. All edges of a level's components lead
    to finished ones, so their words can be read from there.
    """
    spark, number = open_.sparkSession, 0
    while not ready.isEmpty():
        if leaves_have_edges or number:
            full = _read(spark, down).unionByName(own).withColumnRenamed("comp", "target_id")
            here = steps.join(ready.withColumnRenamed("comp", "source_id"), "source_id", "left_semi").join(full, "target_id")
            words = here.groupBy(F.col("source_id").alias("comp"), "kind", "word").agg(F.bit_or("bits").alias("bits"))
            words.write.parquet(f"{down}/round={number:06d}")
        at_end = ready.withColumnRenamed("comp", "target_id")
        left = materialize(open_.join(at_end, "target_id", "left_anti").select("source_id", "target_id"))
        before = open_.join(at_end, "target_id", "left_semi").select(F.col("source_id").alias("comp")).distinct()
        ready = materialize(before.join(left.select(F.col("source_id").alias("comp")), "comp", "left_anti"))
        open_, number = left, number + 1
    return open_


def components(edges: DataFrame) -> DataFrame:
    """(node_id, comp) for every node of the edges: comp is the smallest node of its strongly connected component.

    The smallest ancestor of each node colors the graph; the nodes of a color that reach their color's node are one
    component. They leave the graph, and so on. Nodes without a way in or out are trimmed first, they are alone.
    """
    everything = edges.select(F.col("source_id").alias("node_id")).union(edges.select("target_id")).distinct()
    found = None
    open_ = materialize(edges.select("source_id", "target_id").filter("source_id <> target_id").distinct())
    while True:
        open_ = _trimmed(open_)
        if open_.isEmpty():
            break
        colors = _colors(open_)
        colored = open_.join(colors.withColumnsRenamed({"node_id": "source_id", "color": "from"}), "source_id").join(
            colors.withColumnsRenamed({"node_id": "target_id", "color": "to"}), "target_id")
        inside = materialize(colored.filter(F.col("from") == F.col("to")).select("source_id", "target_id"))
        level = found_now = materialize(colors.filter("node_id = color"))
        while not level.isEmpty():
            before = inside.join(level.withColumnRenamed("node_id", "target_id"), "target_id").select(F.col("source_id").alias("node_id"), "color").distinct()
            level = materialize(before.join(found_now.select("node_id"), "node_id", "left_anti"))
            found_now = materialize(found_now.union(level))
        found = found_now if found is None else materialize(found.union(found_now))
        gone = found_now.select("node_id")
        open_ = materialize(open_.join(gone.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti").join(
            gone.withColumnRenamed("node_id", "target_id"), "target_id", "left_anti").select("source_id", "target_id"))
    if found is None:
        return everything.withColumn("comp", F.col("node_id"))
    return everything.join(found, "node_id", "left").select("node_id", F.coalesce("color", "node_id").alias("comp"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges that have an edge before and an edge after them, again and again."""
    while True:
        kept = materialize(
            edges.join(edges.select(F.col("source_id").alias("target_id")).distinct(), "target_id", "left_semi")
            .join(edges.select(F.col("target_id").alias("source_id")).distinct(), "source_id", "left_semi").select("source_id", "target_id"))
        if kept.count() == edges.count():
            return kept
        edges = kept


def _colors(edges: DataFrame) -> DataFrame:
    """(node_id, color): the smallest node from which a node can be reached, itself included."""
    nodes = edges.select(F.col("source_id").alias("node_id")).union(edges.select("target_id")).distinct()
    colors = materialize(nodes.withColumn("color", F.col("node_id")))
    while True:
        along = edges.join(colors.withColumnRenamed("node_id", "source_id"), "source_id").groupBy(F.col("target_id").alias("node_id")).agg(
            F.min("color").alias("_in"))
        lower = materialize(colors.join(along, "node_id", "left").select(
            "node_id", F.least("color", "_in").alias("color"), (F.col("_in") < F.col("color")).alias("_changed")))
        colors = lower.select("node_id", "color")
        if lower.filter("_changed").isEmpty():
            return colors


def reach_counts(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(node_id, kind, total): how many distinct items the nodes hold that can be reached from a node, itself left out.

    ``own`` are the items of each node as ``numbered`` gives them. Nodes that reach none have no row. On a cycle a node reaches the other members.
    """
    spark = edges.sparkSession
    steps = materialize(edges.select("source_id", "target_id").filter("source_id <> target_id").distinct())
    down = _words_folder(spark)
    ready = materialize(steps.select(F.col("target_id").alias("comp")).distinct().join(
        steps.select(F.col("source_id").alias("comp")), "comp", "left_anti"))
    open_ = _levels(steps, steps, ready, own.withColumnRenamed("node_id", "comp"), down)
    totals = _totals(spark, down)
    if open_.isEmpty():
        return totals.withColumnRenamed("comp", "node_id")

    # Cycles and nodes before them: the same once more with components in place of nodes; their edges to finished nodes count as well.
    member = materialize(components(open_))
    here = materialize(own.join(member, "node_id"))
    mapped = steps.join(member.toDF("source_id", "_s"), "source_id").join(member.toDF("target_id", "_t"), "target_id", "left")
    rest = materialize(mapped.select(F.col("_s").alias("source_id"), F.coalesce("_t", "target_id").alias("target_id"), F.col("_t").isNull().alias("done")).filter(
        "source_id <> target_id").distinct())
    between = rest.filter("not done").select("source_id", "target_id")
    last = materialize(member.select("comp").distinct().join(between.select(F.col("source_id").alias("comp")), "comp", "left_anti"))
    own_all = here.select("comp", "kind", "word", "bits").unionByName(
        own.join(member, "node_id", "left_anti").withColumnRenamed("node_id", "comp")).unionByName(_read(spark, down))
    around = _words_folder(spark)
    _levels(rest, between, last, materialize(own_all), around, leaves_have_edges=True)

    # Inside a component a node also reaches what the other members hold: all that is not below the component anyway,
    # less what only the node itself holds.
    below = _read(spark, around).withColumnRenamed("bits", "_below")
    held = here.groupBy("comp", "kind", "word", "bits").agg(F.count("*").alias("holders"), F.min("node_id").alias("holder"))
    held = materialize(held.join(below, ["comp", "kind", "word"], "left").filter("bits & coalesce(_below, 0L) = 0"))
    parts = [
        member.join(_totals(spark, around), "comp").select("node_id", "kind", "total"),
        member.join(held.groupBy("comp", "kind").agg(F.count("*").alias("total")), "comp").select("node_id", "kind", "total"),
        held.filter("holders = 1").groupBy(F.col("holder").alias("node_id"), "kind").agg((-F.count("*")).alias("total")),
    ]
    cyclic = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("node_id", "kind").agg(F.sum("total").alias("total")).filter("total > 0")
    return totals.withColumnRenamed("comp", "node_id").unionByName(cyclic)


def _words_folder(spark: SparkSession) -> str:
    """A folder of words that can be read before the first level is written."""
    folder = scratch_path(spark, "down")
    spark.createDataFrame([], _WORDS).write.parquet(f"{folder}/round=start")
    return folder


def _read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_WORDS).parquet(folder).select("comp", "kind", "word", "bits")


def _totals(spark: SparkSession, down: str) -> DataFrame:
    return _read(spark, down).groupBy("comp", "kind").agg(F.sum(F.bit_count("bits")).alias("total"))
