"""Runs: maximal stretches of words that repeat with a smallest period, found in tiles per period octave and stitched.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and a length of at least
max(LEAST_LENGTH, LEAST_TURNS * q) that no neighbouring word extends.

Octave B = 1, 2, 4, ... stands for the periods B <= q < 2B. Its tiles lie around anchors 3B words apart and overlap: a tile reaches 3B
words to the left and 5B to the right of its anchor. Every run of such a period has an anchor a at which words a and a + q are
equal. Around it, two Z-functions give for all q at once how far the words q apart go on being equal, to the right (words
from the anchor on) and to the left (the words before it, backwards); both stop at the edge of the tile. What comes out is a fragment
of a run, an interval of positions i with word i = word i + q. Tiles know nothing of each other; fragments of one document
and period are brought together by a shuffle and stitched where they touch. A period that is a multiple of a smaller one is
dropped inside its tile, since the words of one turn already show it.

A tile is only solved if a block of B words at its anchor, or the B words before, occurs again B to 2B - 1 words later: a fragment
that matters spans 3B or more equal positions, so one of these blocks lies in it. Hashes of blocks of length 2B come from two of length B, so
this costs a few array operations per octave. Equal hashes of different blocks cost a tile, never a result.

Texts without fragments are finished where they are read. Only the others are shuffled, once, next to their runs.

Edge cases: null and empty texts have no words and no run; a null doc_id stays null; repeated rows give the same result each; ids
with several texts are kept apart by text; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.tables import materialize
from tapeloom.llm.textbytes import mix64

LEAST_LENGTH, LEAST_TURNS = 6, 4
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_WORDS = 1 << 19
_WORD = re.compile(WORD)
_FRAGMENT = pa.struct([("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
_RUNS = "array<struct<start:bigint,period:bigint,length:bigint>>"


def z_function(s: list) -> list[int]:
    """For each position, how long the suffix from there agrees with the beginning of s."""
    n, left, right = len(s), 0, 0
    z = [0] * n
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _prime_factors(q: int) -> list[int]:
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return found + [q] if q > 1 else found


def solve_tile(codes: np.ndarray, anchor: int, block: int) -> list[tuple[int, int, int]]:
    """(period, start, stop) of the fragments at the anchor for block <= period < 2 * block.

    stop - start positions i satisfy codes[i] == codes[i + period]. A fragment that ends inside the tile is whole
    and kept only if it is long enough for a run.
    """
    reach = 3 * block
    low, high = max(0, anchor - reach), min(len(codes), anchor + reach + 2 * block)
    ahead = z_function(codes[anchor:high].tolist())
    before = codes[low:anchor][::-1].tolist()
    text = codes[low:min(len(codes), anchor + 2 * block - 1)][::-1].tolist()
    back = z_function([*before, None, *text])[len(before) + 1:]
    found = []
    shift = len(text) - len(before) - 1
    for q in range(block, min(2 * block, len(ahead))):
        right = min(ahead[q], reach)
        if not right:
            continue
        left = min(back[shift - q + 1], len(before)) if before and shift - q + 1 >= 0 else 0
        span = left + right
        cut = left == reach or right == reach
        if not cut and span < max((LEAST_TURNS - 1) * q, LEAST_LENGTH - q):
            continue
        if any(ahead[q // p] >= q - q // p for p in _prime_factors(q)):
            continue
        found.append((q, anchor - left, anchor + right))
    return found


def fragments(codes: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """Fragments over codes of words; longest bounds the length of any run, so the octaves end there."""
    n, block = len(codes), 1
    top = 1
    while LEAST_TURNS * 2 * top <= longest:
        top *= 2
    # Codes that occur nowhere else make every window of the last blocks complete.
    padded = np.concatenate([codes, np.arange(4 * top, dtype=np.int64) + (1 << 62)])
    names = mix64(padded.astype(np.uint64) + np.uint64(1))
    found = []
    while LEAST_TURNS * block <= longest:
        blocks = -(-n // block)
        later = names[block:block + blocks * block].reshape(blocks, block)
        again = (later == names[:blocks * block:block, None]).any(axis=1)
        at = np.arange(0, blocks, 3)
        live = again[at] | np.concatenate([[False], again[at[1:] - 1]])
        for j in at[live].tolist():
            found += solve_tile(codes, j * block, block)
        names = mix64(names[:-block] * np.uint64(0x9E3779B97F4A7C15) + names[block:])
        block *= 2
    return found


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str, list[str]]]]:
    """(doc_id, text, words) for chunks of about CHUNK_WORDS words."""
    held, total = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            words = _WORD.findall(text)
            held.append((doc_id, text, words))
            total += len(words) + 1
            if total >= CHUNK_WORDS:
                yield held
                held, total = [], 0
    if held:
        yield held


def _result(text: str, digest: bool) -> str:
    return hashlib.sha256(text.encode()).hexdigest() if digest else text


def scan(docs: DataFrame, digest: bool = False) -> DataFrame:
    """One row per document: (key, doc_id, text, collapsed, fragments); a document without fragments is finished, its text is left out."""
    schema = pa.schema([
        ("key", pa.binary()), ("doc_id", pa.int64()), ("text", pa.string()), ("collapsed", pa.string()), ("fragments", pa.list_(_FRAGMENT))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _documents(batches):
            number: dict[str, int] = {}
            bounds = np.cumsum([0] + [len(w) + 1 for _, _, w in chunk])
            codes = np.empty(bounds[-1], dtype=np.int64)
            for k, (_, _, words) in enumerate(chunk):
                codes[bounds[k]:bounds[k + 1] - 1] = [number.setdefault(w, len(number)) for w in words]
                # One code per boundary that no word has: nothing is equal across documents.
                codes[bounds[k + 1] - 1] = -1 - k
            mine: list[list[dict]] = [[] for _ in chunk]
            found = fragments(codes, max(len(w) for _, _, w in chunk))
            owner = np.searchsorted(bounds, [start for _, start, _ in found], side="right") - 1
            for k, (q, start, stop) in zip(owner.tolist(), found, strict=True):
                mine[k].append({"period": q, "start": start - int(bounds[k]), "stop": stop - int(bounds[k])})
            rows = [
                (hashlib.sha256(f"{i} {t}".encode()).digest(), i, t, None, f) if f else (None, i, None, _result(" ".join(w), digest), None)
                for (i, t, w), f in zip(chunk, mine, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ddl = "key binary, doc_id long, text string, collapsed string, fragments array<struct<period:bigint,start:bigint,stop:bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def stitch(parts: DataFrame) -> DataFrame:
    """(key, start, period, length) of each run, from fragments (key, period, start, stop)."""
    line = Window.partitionBy("key", "period").orderBy("start", "stop")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("start") > F.max("stop").over(before), F.lit(True))
    islands = parts.distinct().withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(line))
    whole = islands.groupBy("key", "period", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    runs = whole.select("key", "start", "period", (F.col("stop") - F.col("start") + F.col("period")).alias("length"))
    return runs.filter(F.col("length") >= F.greatest(F.lit(LEAST_LENGTH), LEAST_TURNS * F.col("period")))


def collapse(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, runs, collapsed) of each document; runs (start, period, length) by start, then period.

    collapsed: the words that no run holds after its first turn, joined by one blank; its SHA-256 with ``digest``.
    """
    scanned = materialize(scan(docs, digest))
    clean = scanned.filter("key is null").select("doc_id", F.array().cast(_RUNS).alias("runs"), "collapsed")
    pending = scanned.filter("key is not null")
    parts = pending.select("key", F.explode("fragments").alias("f")).select("key", "f.period", "f.start", "f.stop")
    runs = stitch(parts).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    joined = pending.select("key", "doc_id", "text").join(runs, "key", "left")
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "period", "length")]))), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("runs").to_pylist(), strict=True):
                words = _WORD.findall(text.as_py())
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for r in found:
                    edge[r["start"] + r["period"]] += 1
                    edge[r["start"] + r["length"]] -= 1
                kept = compress(words, (np.cumsum(edge[:-1]) == 0).tolist())
                rows.append((doc_id, found, _result(" ".join(kept), digest)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    finished = joined.select("doc_id", "text", F.coalesce("runs", F.array().cast(_RUNS)).alias("runs")).mapInArrow(run, f"doc_id long, runs {_RUNS}, collapsed string")
    return clean.unionByName(finished)


def looped(doc_id: Column, text: Column) -> Column:
    """The words of a text joined by one blank, with the tail of one document in ten turned into a loop.

    h = crc32 of the id as text, g = floor(h / 10). If h % 10 = 0, each word i >= a becomes word a + (i - a) % p with
    a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Other texts, and those of null ids, stay as they are.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def turned(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        taken = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(words, F.when(i < a, i).otherwise(a + (i - a) % p) + 1))
        return F.when(n > 0, F.array_join(taken, " ")).otherwise("")

    # The outer transform binds the words, so a text is split once and not once per word.
    words = F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)))
    return F.when(h % 10 == 0, F.element_at(F.transform(words, turned), 1)).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """The run with the greatest length / period of each document, and digests of its runs and of its collapsed text."""
    found = collapse(docs, digest=True)
    best = F.reduce(
        "runs", F.lit(None).cast("struct<start:bigint,period:bigint,length:bigint>"),
        lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))
