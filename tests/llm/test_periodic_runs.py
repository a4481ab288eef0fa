import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import periodic_runs as runs_of
from tapeloom.llm.tables import read

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """(start, period, length) by checking every period at every place."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q) and not any(
                    all(words[start + k] == words[start + k + d] for k in range(length - d)) for d in range(1, q)):
                found.append((start, q, length))
    return sorted(found)


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, q, m in found)]
    best = min(found, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=(None, None, None))
    s, q, m = best
    lines = "".join(f"{a},{c},{b}\n" for a, b, c in found)
    return (doc_id, len(found), s, m, q, None if q is None else 1000 * m // q,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def stitched(words):
    """Runs of one sequence through tiles and a plain union of intervals."""
    table = {}
    codes = np.array([table.setdefault(w, len(table)) for w in words] + [-1], dtype=np.int64)
    spans = {}
    for q, a, b in sorted(set(runs_of.fragments(codes, len(words)))):
        mine = spans.setdefault(q, [])
        if mine and a <= mine[-1][1]:
            mine[-1][1] = max(mine[-1][1], b)
        else:
            mine.append([a, b])
    return sorted((a, q, b - a + q) for q, mine in spans.items() for a, b in mine if b - a + q >= max(6, 4 * q))


@pytest.mark.parametrize("seed", range(6))
def test_tiles_find_what_brute_force_finds(seed):
    rng = random.Random(seed)
    for _ in range(120):
        words = []
        while len(words) < rng.randrange(1, 260):
            if rng.random() < 0.5:
                turn = [rng.choice("abc") for _ in range(rng.randrange(1, 24))]
                words += (turn * 9)[:rng.randrange(1, 9 * len(turn))]
            else:
                words += [rng.choice("abcdefgh"[:rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 30))]
        assert stitched(words) == brute_runs(words), words


def test_words_of_one_kind_and_long_turns():
    assert stitched(["a"] * 5) == [] and stitched(["a"] * 6) == [(0, 1, 6)]
    assert stitched(["a"] * 5_000) == [(0, 1, 5_000)]
    turn = prose(1, 700).split()
    assert stitched(["x"] + turn * 5 + ["y"]) == [(1, 700, 3_500)]
    assert stitched(turn * 3 + turn[:699]) == []


def test_z_function():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.choice("ab") for _ in range(rng.randrange(0, 30))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert runs_of.z_function(s) == want


def texts():
    rng = random.Random(9)
    rows = [(k, prose(k, rng.randrange(1, 120))) for k in range(100)]
    for k in range(100, 140):
        turn = prose(k, rng.randrange(1, 12))
        rows.append((k, f"{prose(k, 5)}  {(turn + chr(9)) * rng.randrange(3, 9)}\n{(turn.split()[0] + ' ') * rng.randrange(1, 12)}end"))
    return rows


def test_query_matches_brute_force(spark, documents_of, odd_rows, monkeypatch):
    rows = texts() + [(i, t) for i, t, _ in odd_rows if t is None or len(t) < 10_000]
    rows += [(None, "u v " * 9), (None, "u v " * 9), (7_000, "u v " * 9), (7_000, "w " * 9)]
    want = sorted((brute_row(i, t) for i, t in rows), key=str)
    docs = documents_of([(i, t, "a") for i, t in rows])
    for chunk in (1 << 19, 50):
        monkeypatch.setattr(runs_of, "CHUNK_WORDS", chunk)
        damaged = docs.withColumn("text", runs_of.looped(F.col("doc_id"), F.col("text")))
        assert sorted((tuple(r) for r in runs_of.report(damaged).collect()), key=str) == want
    assert sum(r[1] for r in want) > 50


def test_texts_come_out_collapsed(spark, documents_of):
    docs = documents_of([(1, "a  b a b a b a b c", "x"), (2, "p\tq", "x"), (3, None, "x")])
    got = {r["doc_id"]: (r["collapsed"], [tuple(x) for x in r["runs"]]) for r in runs_of.collapse(docs).collect()}
    assert got == {1: ("a b c", [(0, 2, 8)]), 2: ("p q", []), 3: ("", [])}
    assert runs_of.collapse(documents_of([])).count() == 0


def test_given_documents_against_brute_force(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents").filter("length(text) < 12000")
    damaged = docs.withColumn("text", runs_of.looped(F.col("doc_id"), F.col("text")))
    got = sorted((tuple(r) for r in runs_of.report(damaged).collect()), key=str)
    assert got == sorted((brute_row(r["doc_id"], r["text"]) for r in docs.collect()), key=str)


def test_a_hot_text_is_stitched_once(spark, documents_of):
    docs = documents_of([(None, "u v w " * 40, "a")] * 3_000)
    found = [tuple(r) for r in runs_of.report(docs).collect()]
    assert len(found) == 3_000 and set(found) == {brute_row(None, "u v w " * 40)}
