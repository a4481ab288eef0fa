"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of letters and digits (case kept) and runs of punctuation, hashed to 2**14
buckets. Every bucket has a fixed sparse index vector of +1 and -1. The context vector of a bucket is the
sum of the index vectors of its neighbours, two to either side, over **all** given documents:
tasks add up integer matrices of a fixed size, an aggregate sums them, so the result does not depend
on the order. Centred and scaled to length one, these are the word vectors. A document is pooled as
their mean and deviation over its tokens, the mean change from a token to the next, and its log length; repetition shows as
a small deviation, markup as its own direction.

The network (tanh layer, logistic output) is trained with numpy on at most ``max_rows`` labelled
rows per class outside the held-out rows, weighted back to the class shares. A temperature fitted
on a fifth of these rows that the weights never saw calibrates the probabilities.

Edge cases: null and empty texts pool to zeros and get the score of that point. No labelled row: 1
(nothing is known to be bad). One class only: its smoothed share. Disagreeing labels of one id: the larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.tables import sigmoid
from tapeloom.llm.textbytes import mix64, token_chunks
from tapeloom.llm.toxicity import training_rows  # the bounded draw of labelled rows

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 32, 2, 2
MAX_ROWS = 5_000
HIDDEN = 24


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(positions, signs), each BUCKETS x NONZERO."""
    h = mix64(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(seed << 32)).reshape(BUCKETS, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1, -1).astype(np.int64)


def _token_buckets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, last, tokens in token_chunks(texts, lower=False, punctuation=True):
        yield first, last, tokens.text, (tokens.hash % np.uint64(BUCKETS)).astype(np.int64)


def context_counts(batches: Iterator[pa.Array]) -> np.ndarray:
    """BUCKETS x DIM integer sums of the index vectors around each bucket."""
    place, sign = index_vectors()
    total = np.zeros(BUCKETS * DIM, dtype=np.int64)
    for texts in batches:
        for _, _, text, bucket in _token_buckets(texts):
            for step in range(1, WINDOW + 1):
                near = text[step:] == text[:-step]
                left, right = bucket[:-step][near], bucket[step:][near]
                for k in range(NONZERO):
                    cells = np.concatenate([left * DIM + place[right, k], right * DIM + place[left, k]])
                    values = np.concatenate([sign[right, k], sign[left, k]])
                    total += np.bincount(cells, weights=values, minlength=len(total)).astype(np.int64)
    return total.reshape(BUCKETS, DIM)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """BUCKETS x DIM float32; what reaches the driver is that table, whatever the corpus."""
    names = [f"c{i}" for i in range(DIM)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = context_counts(batch.column(0) for batch in batches)
        seen = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *[pa.array(total[seen, i]) for i in range(DIM)]], ["bucket", *names])

    partial = docs.select(text).mapInArrow(count, "bucket int, " + ", ".join(f"{n} long" for n in names))
    table = partial.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    raw = np.zeros((BUCKETS, DIM))
    raw[table.column("bucket").to_numpy()] = np.stack([table.column(n).to_numpy() for n in names], axis=1) if len(table) else 0.0
    length = np.linalg.norm(raw, axis=1, keepdims=True)
    unit = np.divide(raw, length, out=np.zeros_like(raw), where=length > 0)
    unit[length[:, 0] > 0] -= unit[length[:, 0] > 0].mean(axis=0) if (length > 0).any() else 0.0
    length = np.linalg.norm(unit, axis=1, keepdims=True)
    return np.divide(unit, length, out=np.zeros_like(unit), where=length > 1e-9).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row per text: mean, deviation, mean absolute step and log length."""
    out = np.zeros((len(texts), 3 * DIM + 1))
    for first, last, text, bucket in _token_buckets(texts):
        n = last - first
        count = np.bincount(text, minlength=n).astype(float)
        used = np.flatnonzero(count)
        if not len(used):
            continue
        begin = np.searchsorted(text, used)
        x = vectors[bucket].astype(np.float64)
        per = count[used][:, None]
        mean = np.add.reduceat(x, begin) / per
        spread = np.sqrt(np.maximum(np.add.reduceat(x * x, begin) / per - mean**2, 0.0))
        step = np.abs(np.diff(x, axis=0, append=x[-1:]))
        step[np.append(begin[1:], len(x)) - 1] = 0.0
        out[first + used] = np.hstack([mean, spread, np.add.reduceat(step, begin) / per, np.log1p(per)])
    return out


@dataclass
class Network:
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(((x - self.center) / self.scale) @ w1 + b1) @ w2 + b2[0]

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return sigmoid(self.logits(pooled(texts, self.vectors)) / self.temperature)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, vectors: np.ndarray, epochs: int = 60, batch: int = 128, seed: int = 3) -> Network:
    """Mini-batch Adam; every fifth row only calibrates."""
    rng = np.random.default_rng(seed)
    apart = np.arange(len(y)) % 5 == 4
    if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        apart[:] = False
    rows = np.flatnonzero(~apart)
    center, scale = x[rows].mean(axis=0), x[rows].std(axis=0) + 1e-3
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
    net = Network(vectors, center, scale, layers)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in layers]
    z = (x - center) / scale
    step = 0
    for _ in range(max(epochs, 3000 * batch // max(1, len(rows)) if len(rows) < 4000 else 0)):
        order = rng.permutation(rows)
        for at in range(0, len(order), batch):
            i = order[at:at + batch]
            step += 1
            hidden = np.tanh(z[i] @ layers[0] + layers[1])
            error = weight[i] * (sigmoid(hidden @ layers[2] + layers[3][0]) - y[i]) / weight[i].sum()
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            grads = [z[i].T @ back + 3e-4 * layers[0], back.sum(axis=0), hidden.T @ error + 3e-4 * layers[2], np.array([error.sum()])]
            for p, g, (m, s) in zip(layers, grads, moments, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    hold = np.flatnonzero(apart) if apart.any() else rows
    logit = net.logits(x[hold])
    grid = np.exp(np.linspace(np.log(0.5), np.log(8.0), 101))
    loss = [-(weight[hold] * np.log(np.clip(sigmoid(np.where(y[hold] == 1, logit, -logit) / t), 1e-12, 1))).sum() for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", corpus: DataFrame | None = None, max_rows: int = MAX_ROWS) -> Network:
    """docs are joined with labels; word vectors come from all of corpus (docs where None)."""
    rows, counts = training_rows(docs, labels, label, max_rows, lower=False)
    empty = Network(np.zeros((0, 0), dtype=np.float32), np.zeros(0), np.ones(0), [])
    total = sum(counts.values())
    if not total or len(counts) < 2:
        empty.constant = (counts.get(1, 0) + 0.5) / (total + 1.0) if total else 1.0
        return empty
    vectors = word_vectors(docs if corpus is None else corpus)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.FixedSizeListArray.from_arrays(pa.array(pooled(batch.column("text"), vectors).ravel()), 3 * DIM + 1)
            yield pa.RecordBatch.from_arrays([batch.column("y"), lists.cast(pa.list_(pa.float64()))], ["y", "x"])

    table = rows.mapInArrow(pool, "y int, x array<double>").toArrow()
    y = table.column("y").to_numpy().astype(np.int64)
    if not len(y) or y.min() == y.max():
        empty.constant = (counts.get(1, 0) + 0.5) / (total + 1.0)
        return empty
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    # Rows arrive in any order; a fixed order makes reruns agree. The classes alternate in hash order.
    order = np.lexsort(tuple(np.round(x[:, :6], 9).T))
    x, y = x[order], y[order]
    share = counts[1] / total
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return fit(x, y, weight, vectors)


def score(model: Network, text: Column | str = "text") -> Column:
    """Probability of good quality of a text column."""
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.scores(texts))

    return run(F.col(text) if isinstance(text, str) else text)

