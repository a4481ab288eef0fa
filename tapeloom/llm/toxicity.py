"""Toxicity: a factorization machine over hashed terms.

Terms are the lower-cased words of the whole text and the first four and five bytes of each word
(stems of words that take many endings), hashed to 2**20 buckets; a term counts once per text.
The score is sigmoid(b + sum of w + sum over pairs of <v, v'>): the pairwise part raises the score
of terms that only together mean harm, such as an insult with the mention of a group.

Learning is bounded: at most ``max_rows`` labelled rows of each class, the ones whose ids hash
lowest, weighted back to the share of their class among all labelled rows. A term gets weights if its presence
depends on the label (chi-square), or if what these leave unexplained depends on it together with another term: every
pair of terms that PAIR_ROWS drawn rows hold each is tested for its interaction in the residuals, in blocks of
the term-by-term table dealt over the executors. Other terms get none, so long clean texts do not add up noise. The
number of terms has no cap.

Edge cases: null and empty texts have no terms and score sigmoid(b). No labelled row: 0. One class
only: its smoothed share. Labels of one id that disagree or are null: toxic if any says so, null ones are skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.tables import held_out, sigmoid
from tapeloom.llm.textbytes import mix64, token_chunks

BUCKET_BITS = 20
PREFIX_BYTES = (4, 5)
MAX_ROWS = 4_000
MIN_CHI2 = 15.0
#: An interaction is a contrast of four means; a term of fewer rows can hardly reach MIN_Z, the bar for so many pairs.
PAIR_ROWS = 40
MIN_Z = 8.0
#: Steady but tiny differences between residuals are no interaction worth a weight.
MIN_CONTRAST = 0.25
PAIR_BLOCK = 1_024


def hashed_terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, text, bucket): every term of the texts first..last, repeats included."""
    mask = np.uint64((1 << BUCKET_BITS) - 1)
    for first, last, tokens in token_chunks(texts, prefix_bytes=PREFIX_BYTES):
        kinds = [tokens.hash, *(mix64(tokens.prefixes[k] + np.uint64(k)) for k in PREFIX_BYTES)]
        yield first, last, np.tile(tokens.text, len(kinds)), (np.concatenate(kinds) & mask).astype(np.int64)


def _distinct(text: np.ndarray, term: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(text * span + term)
    return key // span, key % span


@dataclass
class FactorizationMachine:
    """buckets: the terms with weights, sorted; constant: the score where nothing could be learned."""

    buckets: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray
    constant: float | None = None

    def logits(self, text: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(text, weights=self.w[slot], minlength=n) + self.bias
        for f in range(self.v.shape[1]):
            part = self.v[slot, f]
            z += 0.5 * (np.bincount(text, weights=part, minlength=n) ** 2 - np.bincount(text, weights=part**2, minlength=n))
        return z

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.constant if self.constant is not None else 0.0)
        if self.constant is not None:
            return out
        slots = np.full(1 << BUCKET_BITS, -1, dtype=np.int32)
        slots[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        for first, last, text, bucket in hashed_terms(texts):
            slot = slots[bucket]
            used = slot >= 0
            text, slot = _distinct(text[used], slot[used], max(1, len(self.buckets)))
            out[first:last] = sigmoid(self.logits(text, slot, last - first))
        return out


def telling_terms(seen: np.ndarray, a: np.ndarray, n: int, positives: int) -> np.ndarray:
    """Which buckets depend on the label by themselves.

    seen and a count per bucket the texts that hold it, all and those of label 1.
    """
    b = seen - a
    rest = np.maximum((n - seen) * seen * positives * (n - positives), 1e-9)
    chi2 = n * (a * (n - positives - b) - b * (positives - a)) ** 2 / rest
    return (seen >= 2) & (chi2 >= MIN_CHI2)


def interactions(one: np.ndarray, two: np.ndarray, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(|c|, |z|) of c = m11 - m10 - m01 + m00 per column of one and of two (0 or 1, rows x terms).

    m is the mean residual of the rows that hold both terms, the left, the right or none; one row of average
    square is added to each so that small groups stay uncertain.
    """
    contrast = variance = np.float32(0)
    tables = []
    for weight in (np.ones_like(residual), residual, residual**2):
        held = one * weight[:, None]
        both, left, right = held.T @ two, held.sum(axis=0)[:, None], weight @ two
        tables.append((both, left - both, right - both, weight.sum() - left - right + both))
    typical = float((residual**2).mean())
    for sign, n, total, squares in zip((1, -1, -1, 1), *tables, strict=True):
        contrast = contrast + sign * total / (n + 1)
        variance = variance + (np.maximum(squares, 0) + typical) / (n + 1) ** 2
    contrast = np.abs(contrast)
    return contrast, contrast / np.sqrt(np.maximum(variance, 1e-12))


def paired_terms(spark: SparkSession, text: np.ndarray, slot: np.ndarray, residual: np.ndarray, slots: int) -> np.ndarray:
    """Mask of the slots 0..slots-1 that interact with another one; text and slot list the occurrences, once per text."""
    order = np.lexsort((text, slot))
    begin = np.searchsorted(slot[order], np.arange(slots + 1))
    shared = spark.sparkContext.broadcast((begin, text[order], residual.astype(np.float32)))

    def block(b: int) -> np.ndarray:
        begin, rows, residual = shared.value
        low, high = b * PAIR_BLOCK, min((b + 1) * PAIR_BLOCK, slots)
        held = np.zeros((len(residual), high - low), dtype=np.float32)
        held[rows[begin[low]:begin[high]], np.repeat(np.arange(high - low), np.diff(begin[low:high + 1]))] = 1.0
        return held

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                i = (math.isqrt(8 * number + 1) - 1) // 2
                j = number - i * (i + 1) // 2
                one = block(i)
                contrast, z = interactions(one, one if i == j else block(j), shared.value[2])
                if i == j:
                    np.fill_diagonal(z, 0.0)
                a, b = np.nonzero((z >= MIN_Z) & (contrast >= MIN_CONTRAST))
                found = np.unique(np.concatenate([a + i * PAIR_BLOCK, b + j * PAIR_BLOCK]))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["slot"])

    # Pairs of blocks i >= j, numbered row by row.
    blocks = -(-slots // PAIR_BLOCK)
    count = blocks * (blocks + 1) // 2
    pairs = spark.range(0, count, 1, min(count, 8 * spark.sparkContext.defaultParallelism))
    found = pairs.mapInArrow(tested, "slot long").distinct().toArrow().column("slot").to_numpy()
    shared.unpersist()
    return np.isin(np.arange(slots), found)


def fit(text: np.ndarray, slot: np.ndarray, buckets: np.ndarray, label: np.ndarray, share: float, factors: int = 8, epochs: int = 150, seed: int = 7) -> FactorizationMachine:
    """Adam on the weighted log loss; share is that of label 1 among all labelled rows."""
    n = len(label)
    weight = np.where(label == 1, share / label.mean(), (1 - share) / (1 - label.mean())) / n
    rng = np.random.default_rng(seed)
    params = [np.array([np.log(share / (1 - share))]), np.zeros(len(buckets)), rng.normal(0, 0.05, (len(buckets), factors))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    model = FactorizationMachine(buckets, 0.0, params[1], params[2])
    for step in range(1, epochs + 1):
        model.bias = float(params[0][0])
        error = weight * (sigmoid(model.logits(text, slot, n)) - label)
        per = error[text]
        grads = [np.array([error.sum()]), np.bincount(slot, weights=per, minlength=len(buckets)) + 1e-5 * params[1], 1e-4 * params[2]]
        for f in range(factors):
            v = params[2][slot, f]
            total = np.bincount(text, weights=v, minlength=n)
            grads[2][:, f] += np.bincount(slot, weights=per * (total[text] - v), minlength=len(buckets))
        for p, g, (m, s) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    model.bias = float(params[0][0])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS, lower: bool = True) -> tuple[DataFrame, dict[int, int]]:
    """(rows of text and y, rows per class before the bound): labelled rows that are not held out."""
    y = (
        labels.filter((~held_out("doc_id")) & F.col(label).isNotNull()).groupBy("doc_id")
        .agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    )
    counts = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # At most 2 x max_rows ids: that bound is what makes the broadcast safe.
    by_hash = [y.filter(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for k in (0, 1)]
    chosen = F.broadcast(by_hash[0].unionByName(by_hash[1]).withColumnRenamed("doc_id", "_id"))
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id"))
    return rows.select("y", F.lower("text").alias("text") if lower else "text"), counts


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> FactorizationMachine:
    """Learn from labelled rows; labels, lang, source and id never enter a term."""
    rows, counts = training_rows(docs, labels, label, max_rows)

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, text, term in hashed_terms(batch.column("text")):
                text, term = _distinct(text, term, 1 << BUCKET_BITS)
                ends = np.searchsorted(text, np.arange(last - first + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(term.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(first, last - first), lists], ["y", "terms"])

    nothing = FactorizationMachine(np.zeros(0, dtype=np.int64), 0.0, np.zeros(0), np.zeros((0, 1)))
    total = sum(counts.values())
    table = rows.mapInArrow(terms_of, "y int, terms array<int>").toArrow() if total else None
    if table is None or not len(table):
        nothing.constant = 0.0
        return nothing
    y = table.column("y").to_numpy().astype(np.int64)
    if y.min() == y.max():
        nothing.constant = (float(counts.get(1, 0)) + 0.5) / (total + 1.0)
        return nothing
    space = 1 << BUCKET_BITS
    seen, with_one = np.zeros(space), np.zeros(space)
    chunks = [(chunk.column("y").to_numpy(), chunk.column("terms")) for chunk in table.to_batches(max_chunksize=256)]
    for labels_of, lists in chunks:
        per_row = np.repeat(labels_of, np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten().to_numpy()
        np.add.at(seen, flat, 1.0)
        np.add.at(with_one, flat[per_row == 1], 1.0)
    telling = telling_terms(seen, with_one, len(y), int(y.sum()))

    def occurrences(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets, text, slot) of the wanted buckets."""
        buckets = np.flatnonzero(wanted)
        slots = np.full(space, -1, dtype=np.int32)
        slots[buckets] = np.arange(len(buckets), dtype=np.int32)
        rows_of, slots_of, done = [], [], 0
        for labels_of, lists in chunks:
            slot = slots[lists.flatten().to_numpy()]
            owner = np.repeat(np.arange(done, done + len(labels_of), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
            rows_of.append(owner[slot >= 0])
            slots_of.append(slot[slot >= 0])
            done += len(labels_of)
        return buckets, np.concatenate(rows_of), np.concatenate(slots_of)

    share = counts.get(1, 0) / total

    def learned(wanted: np.ndarray) -> tuple[FactorizationMachine, np.ndarray]:
        """The machine over the wanted buckets, and what it leaves unexplained in each drawn row."""
        buckets, text, slot = occurrences(wanted)
        # Collected rows come in any order. Rows are put in order of label and terms, so reruns agree.
        check = np.bincount(text, weights=(mix64(slot.astype(np.uint64)) >> np.uint64(32)).astype(float), minlength=len(y))
        rank = np.empty(len(y), dtype=np.int64)
        order = np.lexsort((check, y))
        rank[order] = np.arange(len(y))
        back = np.lexsort((slot, rank[text]))
        model = fit(rank[text][back], slot[back].astype(np.int64), buckets, y[order], share)
        # Of the draw, where classes have other shares than among all labelled rows.
        shift = np.log(y.mean() / (1 - y.mean())) - np.log(share / (1 - share))
        return model, y - sigmoid(model.logits(text, slot, len(y)) + shift)

    model, residual = learned(telling)
    frequent, text, slot = occurrences(seen >= PAIR_ROWS)
    more = np.zeros_like(telling)
    if len(frequent):
        more[frequent] = paired_terms(docs.sparkSession, text, slot, residual, len(frequent))
    return learned(telling | more)[0] if (more & ~telling).any() else model


def score(model: FactorizationMachine, text: Column | str = "text") -> Column:
    """Score of a text column, 0 to 1."""
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.scores(texts))

    return run(F.lower(F.col(text) if isinstance(text, str) else text))
