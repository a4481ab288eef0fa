"""Approximate nearest neighbours by inner product: a hash-prefix forest over blocks of the index.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm (0 for a query), so that the largest inner product
is the smallest angle. Every tree has a long hash string per vector (signs of orthogonalised random projections),
kept as a sorted array. A query descends every tree to its longest matching prefix and then ascends all trees
in step, one character at a time, until the ranges of that prefix length hold ``wanted`` candidates, repeats counted. All
of them are compared exactly (double precision) and the best k stay.

Placement: vectors are dealt into blocks of about BLOCK rows by a hash of their id, queries into chunks; a task
holds one block with its own forest and one chunk. The best k of each block meet per query in a partial top-k. No vector is
left out of the index; what the forest saves is the exact comparison with the other part of each block. On vectors without
clusters WANTED takes about 85 % of a full block at even norms and nearly all of it at uneven ones, on clustered ones ``wanted`` can be far smaller.

Edge cases: vectors that are null, zero, of another dimension than the most frequent one, or that hold a null or non-finite component
take no part. Rows that share a query's id are its own. Equal scores go to the smaller id. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.tables import materialize

BLOCK, CHUNK = 4_096, 8_192
TREES, BITS = 32, 24
#: Repeats over the trees count, and uneven norms need more: 6,000 keeps a mean recall of 0.97 on full blocks with log-normal norms.
WANTED = 6_000
SEED = 17


def projections(dim: int, seed: int = SEED) -> np.ndarray:
    """dim x (TREES * BITS) directions, orthogonal in groups of dim."""
    rng = np.random.default_rng(seed)
    groups = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-TREES * BITS // dim))]
    return np.hstack(groups)[:, :TREES * BITS]


def codes(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Hash strings as integers, rows x TREES; the first character is the highest bit."""
    bits = (vectors @ directions > 0).reshape(len(vectors), TREES, BITS)
    return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


class Forest:
    """The sorted arrays of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        # Over the largest norm all vectors lie in the unit ball, whatever their magnitude.
        scaled = vectors / longest
        self.ids, self.vectors, self.small = ids, vectors, scaled.astype(np.float32)
        rest = np.sqrt(np.maximum(1.0 - (scaled**2).sum(axis=1), 0.0))
        self.directions = projections(vectors.shape[1] + 1)
        hashed = codes(np.hstack([scaled, rest[:, None]]), self.directions)
        self.order = np.argsort(hashed, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(hashed.T, self.order, axis=1)

    def ranges(self, queries: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """(low, high), queries x TREES: the ranges at the longest common prefix length with enough candidates."""
        hashed = codes(np.hstack([queries, np.zeros((len(queries), 1))]), self.directions)
        low, high = np.zeros(hashed.shape, dtype=np.int64), np.zeros(hashed.shape, dtype=np.int64)
        open_ = np.arange(len(queries))
        for level in range(BITS, -1, -1):
            prefix = hashed[open_] >> (BITS - level)
            for t in range(TREES):
                low[open_, t] = np.searchsorted(self.sorted[t], prefix[:, t] << (BITS - level), side="left")
                high[open_, t] = np.searchsorted(self.sorted[t], (prefix[:, t] + 1) << (BITS - level), side="left")
            open_ = open_[(high[open_] - low[open_]).sum(axis=1) < wanted]
            if not len(open_):
                break
        return low, high

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, wanted: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per query the ids and scores of its best k candidates, in any order."""
        unit = queries / np.abs(queries).max(axis=1, keepdims=True)
        unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
        low, high = self.ranges(unit, wanted)
        # Twice the worst error of a single-precision product of two vectors of norm one or less.
        slack = 2 * (queries.shape[1] + 4) * 2.0**-24
        marked = np.zeros(len(self.ids), dtype=bool)
        for i, (own, query) in enumerate(zip(query_ids, queries, strict=True)):
            marked[:] = False
            for t in range(TREES):
                marked[self.order[t, low[i, t]:high[i, t]]] = True
            found = np.flatnonzero(marked & (self.ids != own))
            if len(found) > k:  # single precision only rules out what cannot be among the best
                rough = self.small[found] @ unit[i].astype(np.float32)
                found = found[rough >= np.partition(rough, -k)[-k] - slack]
            score = (self.vectors[found] * query).sum(axis=1)
            best = np.lexsort((self.ids[found], -score))[:k]
            yield self.ids[found][best], score[best]


def _search_cell(k: int, wanted: int, longest: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("vec_id").to_numpy()
        flat = table.column("v").combine_chunks().flatten().to_numpy()
        vectors = flat.reshape(len(ids), -1)
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if asks.any() and not asks.all():
            forest = Forest(ids[~asks], vectors[~asks], longest)
            for own, (found, score) in zip(ids[asks], forest.search(ids[asks], vectors[asks], k, wanted), strict=True):
                rows.append((np.full(len(found), own), found, score))
        columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return run


def usable(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (common[0]["d"] if common else 0))


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, wanted: int = WANTED, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by ``every``."""
    rows = materialize(usable(embeddings))
    asks = F.col("vec_id") % every == 0
    top = F.array_max(F.transform("v", F.abs))
    # Scaled by its largest component, so that no square overflows.
    norm = F.col("top") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + (x / F.col("top")) * (x / F.col("top"))))
    facts = rows.withColumn("top", top).agg(F.count("*").alias("n"), F.count_if(asks).alias("q"), F.max(norm).alias("longest")).first()
    blocks, chunks = max(1, -(-facts["n"] // block)), max(1, -(-facts["q"] // chunk))
    queries = rows.filter(asks).groupBy("vec_id").agg(F.min("v").alias("v"))

    def dealt(n: int, salt: str):
        return F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id() if salt == "block" else F.lit(salt)), F.lit(n))

    def numbers(n: int):
        return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))

    indexed = rows.select("vec_id", "v", F.lit(False).alias("asks"), dealt(blocks, "block").alias("block"), F.explode(numbers(chunks)).alias("chunk"))
    asked = queries.select("vec_id", "v", F.lit(True).alias("asks"), F.explode(numbers(blocks)).alias("block"), dealt(chunks, "chunk").alias("chunk"))
    found = indexed.unionByName(asked).groupBy("block", "chunk").applyInArrow(
        _search_cell(k, wanted, min(facts["longest"] or 1.0, float(np.finfo(float).max))), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
