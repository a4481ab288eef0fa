"""Packing by optimal length buckets: batches of a token budget with the least padding.

Documents longer than max_length are split into pieces of consecutive tokens, losslessly. The histogram
of all piece lengths has at most max_length rows whatever the corpus; dynamic programming over it finds the
at most ``buckets`` upper limits that minimise total padding. A batch of a bucket holds
budget // limit pieces; pieces follow a seeded hash order, so batches are mixed.

Positions in a bucket come from two levels: the row number inside a lot (a hash range of about LOT_ROWS rows) plus
the number of rows in earlier lots. A bucket of any size is spread over many tasks and only its last batch is short.

Edge cases: null and empty texts become one row of length 0 without bucket and batch; rows of equal id and text are
interchangeable and meet in one lot; rows of one id and other texts, null ids too, are spread by their text; an empty
table gives no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.mixing import words
from tapeloom.llm.tables import materialize

MAX_LENGTH = 4_096
BUDGET = 16_384
BUCKETS = 16
LOT_ROWS = 2_000
SEED = 5


def optimal_limits(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper limits of at most ``buckets`` buckets that minimise sum over items of limit - length.

    best[k][j]: least padding of the j shortest lengths in k buckets; the last bucket is i..j with limit
    length[j - 1]. Each step is one vector operation per j.
    """
    length = np.array(sorted(histogram), dtype=np.int64)
    count = np.array([histogram[x] for x in length.tolist()], dtype=np.int64)
    if not len(length):
        return []
    n, below = len(length), np.concatenate(([0], np.cumsum(count)))
    total = np.concatenate(([0], np.cumsum(count * length)))
    unreachable = np.iinfo(np.int64).max // 4
    best, back = np.full(n + 1, unreachable), []
    best[0] = 0
    for _ in range(min(buckets, n)):
        now, choice = np.full(n + 1, unreachable), np.zeros(n + 1, dtype=np.int64)
        now[0] = 0
        for j in range(1, n + 1):
            cost = best[:j] + length[j - 1] * (below[j] - below[:j]) - (total[j] - total[:j])
            choice[j] = np.argmin(cost)
            now[j] = cost[choice[j]]
        best = now
        back.append(choice)
    limits, j = [], n
    for choice in reversed(back):
        if j:
            limits.append(int(length[j - 1]))
            j = int(choice[j])
    return sorted(limits)


def padding_of(histogram: dict[int, int], limits: list[int]) -> int:
    return sum(n * (min(x for x in limits if x >= length) - length) for length, n in histogram.items())


def batches(
    docs: DataFrame, length: Column | None = None, max_length: int = MAX_LENGTH, budget: int = BUDGET, buckets: int = BUCKETS, lot_rows: int = LOT_ROWS,
) -> DataFrame:
    """(doc_id, piece, start, length, bucket_limit, batch, slot, padding); start is the first token of the piece.

    length counts the tokens of a row (words where None). batch numbers are unique across buckets only with
    bucket_limit; slot is the row inside the batch.
    """
    if budget < max_length:
        raise ValueError("a piece of max_length must fit the budget")
    n = words() if length is None else F.coalesce(length, F.lit(0)).cast("long")
    # With the text, so that many rows of one id (or of none) are spread over the lots.
    digest = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    sized = docs.select(F.col("doc_id").alias("doc_id"), n.alias("n"), digest.alias("digest"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(max_length).cast("long"))
    pieces = materialize(
        sized.select("doc_id", "n", "digest", F.posexplode(starts).alias("piece", "start"))
        .select("doc_id", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(max_length)).alias("length"),
                F.xxhash64(F.lit(SEED), "doc_id", "digest", "piece").alias("key")))
    histogram = {r["length"]: r["count"] for r in pieces.filter("length > 0").groupBy("length").count().collect()}
    limits = optimal_limits(histogram, buckets)
    empty = pieces.filter("length = 0").select(
        "doc_id", "piece", "start", "length", *[F.lit(None).cast("long").alias(c) for c in ("bucket_limit", "batch", "slot", "padding")])
    if not limits:
        return empty
    count = [sum(v for k, v in histogram.items() if k <= x) for x in limits]
    lots = [max(1, -(-c // lot_rows)) for c in np.diff([0, *count]).tolist()]
    index = sum([(F.col("length") > x).cast("int") for x in limits[:-1]], F.lit(0))
    placed = (
        pieces.filter("length > 0").withColumn("bucket", index)
        .withColumn("bucket_limit", F.array(*[F.lit(x).cast("long") for x in limits])[F.col("bucket")])
        .withColumn("lot", F.pmod(F.col("key"), F.array(*[F.lit(x).cast("long") for x in lots])[F.col("bucket")]))
    )
    earlier = Window.partitionBy("bucket").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("bucket", "lot").agg(F.count("*").alias("_n")).select(
        "bucket", "lot", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("before"))
    line = Window.partitionBy("bucket", "lot").orderBy("key", "doc_id", "piece", "length")
    ranked = placed.join(offsets, ["bucket", "lot"]).withColumn("rank", F.col("before") + F.row_number().over(line) - 1)
    per = F.expr(f"{budget} div bucket_limit")
    return ranked.select(
        "doc_id", "piece", "start", "length", "bucket_limit", F.expr(f"rank div ({budget} div bucket_limit)").alias("batch"),
        (F.col("rank") % per).alias("slot"), (F.col("bucket_limit") - F.col("length")).alias("padding"),
    ).unionByName(empty)
