"""Document fingerprints: a quartile bucket digest of hashed byte triplets, compared by a bounded score.

Every triplet of neighbouring UTF-8 bytes falls in one of 128 buckets. A bucket is written as the quarter of
the bucket counts that it belongs to (two bits), after one byte for the length on a logarithmic scale and one for the
ratios of the quartiles: 68 hex digits. The difference of two digests adds the steps between bucket codes (a
step of three counts six), between lengths and between ratios; likeness is 1 - difference / largest difference.

Edge cases: null is the empty text; a text below three bytes has empty buckets and its length; equal texts have
equal fingerprints whatever their id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.tables import materialize

BUCKETS = 128
LENGTH_STEP_COST, LENGTH_STEPS = 4, 24
RATIO_COST = 2
#: Cost of a step of 0..3 quarters between two bucket codes.
STEP_COST = np.array([0, 1, 2, 6], dtype=np.int64)
LARGEST = BUCKETS * 6 + LENGTH_STEP_COST * LENGTH_STEPS + 2 * 15 * RATIO_COST
PIECE_BYTES = 1 << 20


def _triplet_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket counts (texts x BUCKETS) of the texts data[offsets[i]:offsets[i + 1]]."""
    n, counts = len(offsets) - 1, np.zeros((len(offsets) - 1) * BUCKETS, dtype=np.int64)
    for at in range(0, max(0, len(data) - 2), PIECE_BYTES):
        part = data[at:at + PIECE_BYTES + 2].astype(np.uint32)
        mixed = part[:-2] * np.uint32(0x9E3779B1) + part[1:-1] * np.uint32(0x85EBCA77) + part[2:] * np.uint32(0xC2B2AE3D)
        mixed ^= mixed >> np.uint32(15)
        bucket = (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(25)
        place = np.arange(at, at + len(bucket))
        owner = np.searchsorted(offsets, place, side="right") - 1
        inside = place + 2 < offsets[owner + 1]
        counts += np.bincount(owner[inside] * BUCKETS + bucket[inside], minlength=n * BUCKETS)
    return counts.reshape(n, BUCKETS)


def digests(texts: list[bytes]) -> np.ndarray:
    """One row of 34 bytes per text."""
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
    counts = _triplet_counts(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    ordered = np.sort(counts, axis=1)
    q = ordered[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts[:, :, None] > q[:, None, :]).sum(axis=2).astype(np.uint8)
    packed = (code[:, 0::4] << 6) | (code[:, 1::4] << 4) | (code[:, 2::4] << 2) | code[:, 3::4]
    length = np.minimum(255, np.round(np.log1p(np.diff(offsets)) * 10)).astype(np.uint8)
    third = np.maximum(q[:, 2], 1)
    ratios = (np.minimum(15, q[:, 0] * 15 // third) * 16 + np.minimum(15, q[:, 1] * 15 // third)).astype(np.uint8)
    return np.hstack([length[:, None], ratios[:, None], packed])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of digest rows."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    body = np.zeros(len(a), dtype=np.int64)
    for shift in (0, 2, 4, 6):
        body += STEP_COST[np.abs(((a[:, 2:] >> shift) & 3) - ((b[:, 2:] >> shift) & 3))].sum(axis=1)
    length = LENGTH_STEP_COST * np.minimum(LENGTH_STEPS, np.abs(a[:, 0] - b[:, 0]))
    ratio = RATIO_COST * (np.abs((a[:, 1] >> 4) - (b[:, 1] >> 4)) + np.abs((a[:, 1] & 15) - (b[:, 1] & 15)))
    return 1.0 - (body + length + ratio) / LARGEST


def from_hex(fingerprints: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(fingerprints)), dtype=np.uint8).reshape(len(fingerprints), -1)


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in COLUMNS.split(", ")]


def _report(ids: list, texts: list[str], following: list[str]) -> list[list]:
    edited = [edited_text(a, b) for a, b in zip(texts, following, strict=True)]
    raw = [x.encode() for x in edited]
    own, new, after = digests([x.encode() for x in texts]), digests(raw), digests([x.encode() for x in following])
    return [
        ids, [len(x) for x in texts], [hashlib.sha256(x).hexdigest() for x in raw], [x.tobytes().hex() for x in own],
        [x.tobytes().hex() for x in new], likeness(own, new).tolist(), likeness(own, after).tolist(),
    ]


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition: each row but the last knows its next; first and last texts go along for the seams."""
    context = TaskContext.get()
    part = context.partitionId() if context is not None else 0
    held, first = None, None
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ("part", pa.int32()), ("first_text", pa.string()), ("last_text", pa.string())])
    for batch in batches:
        at = 0
        lengths = np.diff(np.concatenate(([0], np.cumsum(batch.column("bytes").to_numpy(zero_copy_only=False)) // PIECE_BYTES)))
        cuts = [*np.flatnonzero(lengths).tolist(), len(batch) - 1]
        for cut in cuts:
            rows = batch.slice(at, cut + 1 - at)
            at = cut + 1
            if not len(rows):
                continue
            ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
            if first is None:
                first = texts[0]
            if held is not None:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = (ids[-1], texts[-1])
            n = len(ids) - 1
            if n:
                columns = _report(ids[:-1], texts[:-1], texts[1:])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip([*columns, [part] * n, [None] * n, [None] * n], schema, strict=True)], schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([c], type=f.type) for c, f in zip([held[0], *[None] * 6, part, first, held[1]], schema, strict=True)], schema=schema)


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            ids, texts, following = (batch.slice(at, 64).column(c).to_pylist() for c in ("doc_id", "last_text", "next_text"))
            yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, type=pa.int64()) for i, c in enumerate(_report(ids, texts, following))], _NAMES)


def edited_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts; the next document is the next smaller doc_id, after the last the first.

    Texts are shuffled once, into ranges of descending doc_id (equal ids by length and hash, null ids last). A task walks its
    sorted range; only the last row of each range needs the first text of the next range, one row per task, joined at the end.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(text).alias("h"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("bytes").desc(), F.col("h")]
    walked = materialize(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_along, COLUMNS + ", part int, first_text string, last_text string"))
    seams = walked.filter("last_text is not null")
    ring = Window.orderBy("part")
    following = seams.select(
        F.col("part").alias("_part"), F.coalesce(F.lead("part").over(ring), F.min("part").over(Window.partitionBy())).alias("_next"))
    firsts = seams.select(F.col("part").alias("_next"), F.col("first_text").alias("next_text"))
    closed = (
        seams.select("doc_id", "last_text", "part").join(following, F.col("part") == F.col("_part")).join(firsts, "_next")
        .select("doc_id", "last_text", "next_text").mapInArrow(_seams, COLUMNS))
    return walked.filter("last_text is null").select(*_NAMES).unionByName(closed)
