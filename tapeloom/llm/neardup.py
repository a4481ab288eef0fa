"""Near duplicates by ProbMinHash signatures, banding and exact verification.

The documents of a table fall into classes: documents of equal text, and documents linked by a
chain of pairs whose similarity reaches the threshold. A shingle is a run of five lower-cased
words (a shorter text is one shingle), its weight 1 + ln(occurrences).

Sketch. Each shingle is a Poisson process whose rate is its weight: exponential gaps, every
arrival falls on a random component of the signature, and a component keeps the shingle that came
first. A shingle stops once its next arrival is later than the latest component of the document,
so a document of n shingles costs about n + m ln m arrivals. Two signatures agree in a component
with probability Jp, the probability Jaccard similarity of the weighted shingles. The same signature with all weights 1
agrees with probability J, the plain Jaccard similarity. Both are banded: where one copy repeats a passage, J stays high
and Jp falls. A document without repeated shingles has one signature for both, so only the others have more bands.

Links. Equal texts collapse to their smallest id. Representatives that share a band are compared
with the center of that bucket, the document that meets most others over all bands. What is then
still in different components inside one bucket is compared pair by pair, except pairs that exact bounds
(see _open_pairs) exclude. So no group is expanded into all its pairs and no link inside a bucket is lost. A pair is a
link if its exact J or Jp reaches the threshold.

Edge cases: null and empty texts have no shingles; equal empty texts are one class, a null text
is alone. Rows that share a doc_id are one document with several texts. A null doc_id gets a
null class. Ties go to the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.components import connected_components
from tapeloom.llm.tables import materialize
from tapeloom.llm.textbytes import mix64, shingles, token_chunks

SHINGLE_WORDS = 5
THRESHOLD = 0.8
ROWS_PER_BAND, BANDS = 6, 30
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def weighted_shingles(text: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of the distinct shingles of each text, sorted."""
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    first = np.ones(len(text), dtype=bool)
    first[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(text)))
    return text[at], shingle[at], 1.0 + np.log(count)


def prob_min_hash(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """Signatures (n_texts x m, shingle ids; 0 in a text without shingles)."""
    first = np.full(n_texts * m, np.inf)
    owner = np.zeros(n_texts * m, dtype=np.uint64)
    clock, state = np.zeros(len(text)), mix64(shingle + _GOLDEN)
    while len(text):
        state = mix64(state + _GOLDEN)
        clock = clock - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        alive = clock <= first.reshape(n_texts, m).max(axis=1)[text]
        text, shingle, weight, clock, state = (x[alive] for x in (text, shingle, weight, clock, state))
        cell = text * m + (mix64(state ^ _GOLDEN) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, cell, clock)
        won = clock == first[cell]
        owner[cell[won]] = shingle[won]
    return owner.reshape(n_texts, m)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 63-bit key per band; the band number is part of it."""
    n, m = signature.shape
    key = np.tile(mix64(np.arange(1, m // rows + 1, dtype=np.uint64)), (n, 1))
    for i in range(rows):
        key = mix64(key + signature[:, i::rows])
    return (key >> np.uint64(1)).astype(np.int64)


def both_band_keys(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, rows: int, bands: int) -> list[np.ndarray]:
    """Per text the distinct keys of the weighted and of the plain signature; none for a text without shingles."""
    weighted = band_keys(prob_min_hash(text, shingle, weight, n_texts, rows * bands), rows)
    keys = [k if has else k[:0] for k, has in zip(weighted, np.bincount(text, minlength=n_texts) > 0, strict=True)]
    repeats = np.zeros(n_texts, dtype=bool)
    repeats[text[weight > 1]] = True
    at, some = np.flatnonzero(repeats), repeats[text]
    number = np.cumsum(repeats) - 1
    plain = band_keys(prob_min_hash(number[text[some]], shingle[some], np.ones(int(some.sum())), len(at), rows * bands), rows)
    for i, more in zip(at, plain, strict=True):
        keys[i] = np.concatenate([keys[i], more[more != keys[i]]])
    return keys


def _sketches(rows: int, bands: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, last, tokens in token_chunks(batch.column("text")):
                n = last - first
                owner, run_hash = shingles(tokens, n, words)
                owner, run_hash, weight = weighted_shingles(owner, run_hash)
                keys = both_band_keys(owner, run_hash, weight, n, rows, bands)
                ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), batch.column("digest").slice(first, n), lists], ["doc_id", "digest", "bands"])
    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float, int]:
    """(J, Jp, number of common shingles) of two weighted sets, each as sorted ids and weights.

    Jp = sum over common d of 1 / sum_e max(a_e / a_d, b_e / b_d). With r = a / b the inner maximum
    is a_e / a_d where r_e >= r_d and b_e / b_d elsewhere, so one sort by r and running sums do.
    """
    (ka, wa), (kb, wb) = a, b
    common, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    union = len(ka) + len(kb) - len(common)
    if not len(common):
        return 0.0, 0.0, 0
    xa, xb = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - xa.sum(), wb.sum() - xb.sum()
    order = np.argsort(xa / xb, kind="stable")
    xa, xb = xa[order], xb[order]
    from_a = np.cumsum(xa[::-1])[::-1]
    below_b = np.concatenate(([0.0], np.cumsum(xb)[:-1]))
    return len(common) / union, float((1.0 / ((from_a + only_a) / xa + (below_b + only_b) / xb)).sum()), len(common)


def _sets(texts: pa.Array, words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for first, last, tokens in token_chunks(texts):
        owner, run_hash, weight = weighted_shingles(*shingles(tokens, last - first, words))
        cut = np.searchsorted(owner, np.arange(last - first + 1))
        out += [(run_hash[cut[i]:cut[i + 1]], weight[cut[i]:cut[i + 1]]) for i in range(last - first)]
    return out


_VERIFIED = "a long, b long, j double, jp double, common long, n long, w double"


def _verify(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                a = part.column("text_a").dictionary_encode()
                sets, which = _sets(a.dictionary, words), a.indices.to_numpy(zero_copy_only=False)
                others = _sets(part.column("text_b"), words)
                found = [similarity(sets[i], other) for i, other in zip(which, others, strict=True)]
                columns = [[x[k] for x in found] for k in range(3)] + [[len(k) for k, _ in others], [float(w.sum()) for _, w in others]]
                kinds = (pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), *[pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]],
                    ["a", "b", "j", "jp", "common", "n", "w"])
    return run


def texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts (doc_id, text) of the given ids (doc_id), written once for all later joins.

    The ids grow with the corpus, so they are not broadcast.
    """
    return materialize(texts.join(ids.distinct().hint("merge"), "doc_id", "left_semi"))


def verified(pairs: DataFrame, texts: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """Exact (a, b, j, jp, common, n, w) of the pairs (a, b); n and w count and weigh the shingles of b.

    A document in very many pairs is a skewed join key, which adaptive execution splits.
    """
    both = (
        pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    )
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(words), _VERIFIED)


def _distinct_shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for first, last, tokens in token_chunks(batch.column("text")):
                owner, run_hash, _ = weighted_shingles(*shingles(tokens, last - first, words))
                yield pa.RecordBatch.from_arrays([pa.array(run_hash.astype(np.int64)), pa.array(ids[first + owner])], ["shingle", "doc_id"])
    return run


def lone_shingles(texts: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, lone): how many distinct shingles of a document no other given document has; 0 for an id with several texts."""
    rows = texts.select("doc_id", "text").mapInArrow(_distinct_shingles(words), "shingle long, doc_id long")
    single = rows.groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("_max")).filter("doc_id = _max")
    counted = single.groupBy("doc_id").agg(F.count("*").alias("lone"))
    several = texts.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("doc_id")
    return counted.join(several, "doc_id", "left_anti")


def _identity(text: Column, doc_id: Column) -> Column:
    """Digest of a text, or of the id of a null text; a mark in front keeps both kinds apart."""
    return F.sha2(F.coalesce(F.concat(F.lit("t"), text), F.concat(F.lit("n"), doc_id.cast("string"))), 256)


def classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = SHINGLE_WORDS, rows: int = ROWS_PER_BAND, bands: int = BANDS) -> DataFrame:
    """(doc_id, class_id, text_id): the smallest id of the class, and of the documents of equal text."""
    text = F.lower(F.col("text")).alias("text")
    given = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = F.unhex(_identity(F.col("text"), F.col("doc_id"))).alias("digest")
    sketch = materialize(
        given.select("doc_id", digest, text).mapInArrow(_sketches(rows, bands, words), "doc_id long, digest binary, bands array<long>")
    )
    first = sketch.groupBy("digest").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("_n"))
    copies = materialize(sketch.select("doc_id", "digest").distinct().join(first.filter("_n > 1"), "digest").select("doc_id", "text_id"))
    # Without the copies: a row stays if no other document of equal text has a smaller id.
    lone = sketch.join(copies.filter("doc_id <> text_id").select("doc_id").distinct(), "doc_id", "left_anti")
    banded = lone.select("doc_id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("doc_id").alias("_min"), F.max("doc_id").alias("_max"), F.count("*").alias("n"))
    met = materialize(banded.join(shared.filter("_min <> _max").select("bucket", "n"), "bucket"))
    density = met.groupBy("doc_id").agg(F.sum("n").alias("density"))
    centers = met.join(density, "doc_id").groupBy("bucket").agg(F.max(F.struct("density", -F.col("doc_id"))).alias("_c"))
    centers = centers.select("bucket", (-F.col("_c.col2")).alias("center"))
    members = materialize(met.select("bucket", "doc_id").join(centers, "bucket").filter("doc_id <> center"))

    stars = members.select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()
    texts = texts_of(given.select("doc_id", text), met.select("doc_id"))
    near = materialize(verified(stars, texts, words))
    same = copies.filter("doc_id <> text_id").select(F.col("text_id").alias("a"), F.col("doc_id").alias("b"))
    is_link = (F.col("j") >= threshold) | (F.col("jp") >= threshold)
    links = near.filter(is_link).select("a", "b").unionByName(same)
    rest = _open_pairs(members, near, connected_components(links), texts, threshold, words)
    more = materialize(verified(rest, texts, words).filter(is_link).select("a", "b"))
    labels = connected_components(links.unionByName(more))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    text_id = copies.groupBy("doc_id").agg(F.min("text_id").alias("text_id"))
    return (
        out.join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").join(text_id, "doc_id", "left")
        .select("doc_id", F.coalesce("label", "doc_id").alias("class_id"), F.coalesce("text_id", "doc_id").alias("text_id"))
    )


def _open_pairs(members: DataFrame, near: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """Pairs of one bucket that are in different components and that no exact bound rules out.

    The largest component of a bucket is never paired with itself: only documents outside it
    look for partners, so a bucket that is one component costs nothing.

    Bounds. x and y have c_x and c_y shingles in common with the center of their bucket and l_x and l_y that no other
    document here, the center included, has, so they share at most C = min(c_x, c_y) + min(n_x - c_x - l_x, n_y - c_y - l_y). Then
    J <= C / (n_x + n_y - C), and since every weight is at least 1 and a b / (a + b) is concave,
    Jp <= 1 / (w_x / (w_x - n_x + C) + w_y / (w_y - n_y + C) - 1). Both distances also obey the triangle inequality.
    """
    known = near.select(F.col("a").alias("center"), F.col("b").alias("doc_id"), "j", "jp", "common", "n", "w")
    placed = (
        members.join(known, ["center", "doc_id"])
        .join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left")
        .withColumn("comp", F.coalesce("label", "doc_id")).drop("label")
    )
    sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("_s"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("_s", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1")
    placed = materialize(placed.join(mixed.select("bucket", "main"), "bucket"))
    here = placed.select("doc_id").unionByName(placed.select(F.col("center").alias("doc_id"))).distinct()
    lone = lone_shingles(texts.join(here.hint("merge"), "doc_id", "left_semi"), words)
    placed = materialize(placed.join(lone, "doc_id", "left").withColumn("other", F.greatest(
        F.col("n") - F.col("common") - F.coalesce("lone", F.lit(0)), F.lit(0))))
    columns = ("doc_id", "comp", "j", "jp", "common", "n", "w", "other", "main")
    x, y = (placed.select("bucket", *[F.col(c).alias(f"{side}_{c}") for c in columns]) for side in "xy")
    shared = F.least("x_common", "y_common") + F.least("x_other", "y_other")
    rest_x, rest_y = F.col("x_w") - F.col("x_n") + shared, F.col("y_w") - F.col("y_n") + shared
    cut, slack = threshold - 1e-9, 1.0 - threshold + 1e-9
    may_j = (shared >= cut * (F.col("x_n") + F.col("y_n") - shared)) & (F.abs(F.col("x_j") - F.col("y_j")) <= slack)
    may_jp = (F.try_divide(F.col("x_w"), rest_x) + F.try_divide(F.col("y_w"), rest_y) - 1 <= 1 / cut) & (F.abs(F.col("x_jp") - F.col("y_jp")) <= slack)
    once = (F.col("y_comp") == F.col("y_main")) | (F.col("x_doc_id") < F.col("y_doc_id"))
    pairs = x.filter("x_comp <> x_main").join(y, "bucket").filter(
        (F.col("x_comp") != F.col("y_comp")) & once & (may_j | F.coalesce(may_jp, F.lit(False))))
    pairs = pairs.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct()
    return materialize(pairs.join(near.select("a", "b"), ["a", "b"], "left_anti"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each class of texts, with all its columns: the smallest id, nulls last, then the smallest digest.

    Where ids are unique they stand for the texts. Else every distinct text is classified under a number of its own, so
    a second text of an id survives and copies under null ids go. Null texts are one row per id; those without an id all stay.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id is null or n > 1").isEmpty():
        found = classes(docs.select("doc_id", "text"), **options).filter("doc_id = class_id").select(F.col("doc_id").alias("id"))
        packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id")).join(found, "id", "left_semi")
        return packed.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    digest = _identity(F.col("text"), F.col("doc_id"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), digest.alias("digest"))
    least = rows.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("id"))
    numbered = materialize(materialize(least).withColumn("number", F.monotonically_increasing_id()))
    texts = rows.join(numbered.select("digest", "number"), "digest").select("number", F.col("row.text").alias("text"))
    # Copies of a text have equal numbers, which classes takes as one document.
    found = classes(texts.select(F.col("number").alias("doc_id"), "text"), **options).select(F.col("doc_id").alias("number"), "class_id")
    rank = F.struct(F.col("id").isNull(), "id", "digest")
    chosen = numbered.join(found, "number").groupBy("class_id").agg(F.min(rank).alias("_r")).select(
        F.col("_r.digest").alias("digest"), F.col("_r.id").alias("_id"))
    kept = rows.join(materialize(chosen), "digest").filter(F.col("id").eqNullSafe(F.col("_id"))).dropDuplicates(["digest"])
    kept = kept.select("row").unionByName(rows.filter("digest is null").select("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
