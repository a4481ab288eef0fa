"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only.

Words are cut into blocks of BLOCK_WORDS. The targets of the sources are the votes, blocks the
seats: seats go to the highest quotients votes / (2 k + 1), first to sources, then within a source to
groups of shards, then to shards. Only the few seats near the last quotient are ranked; the rest
follow from a closed form, so the number of blocks does not matter.

A shard lays its documents end to end in seeded hash order. Its quota is some whole passes over the shard
and the rest as consecutive blocks (cyclic) from a seeded start block; a document gets the
words of the passes and its overlap with those blocks. So no document exceeds max_repeat passes.

Sizes: a shard holds about SHARD_WORDS words, a group SHARDS_PER_GROUP shards, so windows stay small for
a source of any size. The table of sources (one row each) is ordered in one task.

Edge cases: null text has size 0 and is taken 0 times; a null source is a source, last in order; ties of
quotients go to the smaller source or shard; rows of equal id and text are interchangeable and meet in one shard; rows of one id
and other texts, null ids too, are spread by their text; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.tables import materialize

BLOCK_WORDS = 64
SHARD_WORDS = 200_000
SHARDS_PER_GROUP = 4_096
MAX_REPEAT = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column | str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column | str = "source") -> Column:
    """A join key for a source that may be null."""
    c = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))


def seeded(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *parts))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sizes (skey, source, source_size) with target: shares by weight 1, 2, 3, ..., capped, the excess reshared.

    Sources ordered by cap / weight are capped from the front until the share per weight of the others
    (the water level) no longer exceeds their own cap / weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("w", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("cap", max_repeat * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) - capped) / F.sum("w").over(after)
    leveled = weighted.select("*", level.alias("level"), F.row_number().over(order).alias("at"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("at"))
    at = F.min(fits).over(everything)
    water = F.max(F.when(F.col("at") == F.col("first"), F.col("level"))).over(everything)
    return leveled.withColumn("first", at).withColumn("water", water).select(
        "skey", "source_size", F.least(F.col("cap").cast("double"), F.col("water") * F.col("w")).alias("target"))


def apportion(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: Column) -> DataFrame:
    """parties with their number of seats ``won``; seats is the number to give to each group."""
    whole = Window.partitionBy(*group) if group else Window.partitionBy()
    share = F.col(votes) / F.sum(votes).over(whole)
    half = F.count("*").over(whole) / 2.0
    sure = F.floor(share * F.greatest(F.col("_seats") - half, F.lit(0.0)) + 0.5) - 1
    most = F.floor(share * (F.col("_seats") + half) + 0.5) + 1
    bounded = (
        parties.withColumn("_seats", seats)
        .withColumn("_sure", F.coalesce(F.greatest(sure, F.lit(0)), F.lit(0)).cast("long"))
        .withColumn("_most", F.coalesce(most, F.lit(0)).cast("long"))
        .withColumn("_left", F.col("_seats") - F.sum("_sure").over(whole))
    )
    near = bounded.filter((F.col(votes) > 0) & (F.col("_most") > F.col("_sure"))).select(
        *group, *party, F.col(votes).alias("_votes"), "_left", F.explode(F.sequence("_sure", F.col("_most") - 1)).alias("_k"))
    by_quotient = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy(
        (F.col("_votes") / (2 * F.col("_k") + 1)).desc(), *party, "_k")
    extra = near.withColumn("_rank", F.row_number().over(by_quotient)).filter("_rank <= _left").groupBy(*group, *party).agg(
        F.count("*").alias("_extra"))
    return bounded.join(extra, [*group, *party], "left").withColumn(
        "won", F.col("_sure") + F.coalesce("_extra", F.lit(0))).drop("_seats", "_sure", "_most", "_left", "_extra")


def _placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (skey, size, key, ...) with their source's figures, group of shards and shard."""
    return rows.join(sources, "skey").withColumn("shard", _number(F.col("key")) % F.col("shards")).withColumn(
        "wing", F.floor(F.col("shard") / SHARDS_PER_GROUP))


def mix(docs: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(row, size, source_size, target, taken, parts): row is the given row as a struct.

    parts lists what the mix takes of the text as spans (from, to) of word numbers, one per repeat.
    """
    rows = docs.select(
        F.struct("*").alias("row"), source_key().alias("skey"), F.col("source").alias("source"), F.col("doc_id").alias("doc_id"),
        words().alias("size"),
        # With the text, so that many rows of one id (or of none) are spread over the shards.
        seeded(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("key"))
    narrow = materialize(rows.select("skey", "source", "size", "key"))
    sizes = narrow.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    shared = targets(sizes, max_repeat)
    seats = F.floor(F.sum("source_size").over(Window.partitionBy()) / BLOCK_WORDS + 0.5).cast("long")
    sources = materialize(
        apportion(shared, [], ["skey"], "target", seats).withColumnRenamed("won", "source_seats")
        .withColumn("shards", F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.lit(1))))
    cells = _placed(narrow, sources).groupBy("skey", "wing", "shard").agg(
        F.sum("size").alias("cell_size"), F.first("source_seats").alias("source_seats"))
    cells = materialize(cells)
    wings = cells.groupBy("skey", "wing").agg(F.sum("cell_size").alias("wing_size"), F.first("source_seats").alias("source_seats"))
    wings = apportion(wings, ["skey"], ["wing"], "wing_size", F.col("source_seats")).select("skey", "wing", F.col("won").alias("wing_seats"))
    quotas = apportion(cells.join(wings, ["skey", "wing"]), ["skey", "wing"], ["shard"], "cell_size", F.col("wing_seats"))
    words_due = F.least(F.col("won") * BLOCK_WORDS, max_repeat * F.col("cell_size"))
    blocks = F.greatest(F.ceil(F.col("cell_size") / BLOCK_WORDS), F.lit(1))
    start = _number(seeded("skey", F.col("shard").cast("string"))) % blocks * BLOCK_WORDS
    due = quotas.withColumn("due", words_due).select(
        "skey", "wing", "shard", "cell_size", F.expr("if(cell_size > 0, due div cell_size, 0)").alias("passes"),
        F.expr("if(cell_size > 0, due % cell_size, 0)").alias("rest"), start.alias("start"))

    line = Window.partitionBy("skey", "wing", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = _placed(rows, sources).join(due, ["skey", "wing", "shard"]).withColumn("to", F.sum("size").over(line)).withColumn(
        "at", F.col("to") - F.col("size"))

    def overlap(low: Column, high: Column) -> Column:
        a, b = F.greatest(F.col("at"), low), F.least(F.col("to"), high)
        return F.struct((a - F.col("at")).alias("from"), (F.greatest(a, b) - F.col("at")).alias("to"))

    stop = F.col("start") + F.col("rest")
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("from"), F.col("size").alias("to")), F.col("passes").cast("int"))
    spans = F.concat(whole, F.array(
        overlap(F.col("start"), F.least(stop, F.col("cell_size"))), overlap(F.lit(0).cast("long"), stop - F.col("cell_size"))))
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda t, x: t + x["to"] - x["from"])
    return laid.withColumn("parts", F.filter(spans, lambda x: x["to"] > x["from"])).select(
        "row", "doc_id", "size", "source_size", "target", taken.alias("taken"), "parts")


def mixed_documents(docs: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mix as rows: the given columns, one row per repeat; a document taken in part keeps that span of words.

    Whole repeats keep their text as it is. n_chars, where it is given, is counted anew.
    """
    spans = mix(docs, max_repeat).select("row", "size", F.explode("parts").alias("part"))
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.col("part.from").cast("int") + 1, (F.col("part.to") - F.col("part.from")).cast("int")), "")
    text = F.when((F.col("part.from") == 0) & (F.col("part.to") == F.col("size")), F.col("row.text")).otherwise(cut)
    columns = {"text": text} | ({"n_chars": F.char_length(text).cast("long")} if "n_chars" in docs.columns else {})
    return spans.select(*[columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
