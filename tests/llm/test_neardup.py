import random
import re

import numpy as np
import pyarrow as pa

from tapeloom.llm import neardup
from tapeloom.llm.components import connected_components
from tapeloom.llm.textbytes import shingles, token_chunks

from .conftest import prose


def counts_of(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    runs = [tuple(words[i:i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
    return {r: 1 + np.log(runs.count(r)) for r in set(runs)}


def both_similarities(a, b):
    """(J, Jp) straight from the definitions."""
    common = a.keys() & b.keys()
    if not common:
        return 0.0, 0.0
    every = a.keys() | b.keys()
    jp = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in every) for d in common)
    return len(common) / len(every), jp


def brute_classes(rows):
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, t, counts_of(t)) for i, t in rows]
    for k, (i, t, a) in enumerate(sets):
        for j, u, b in sets[:k]:
            if t == u or (a and b and max(both_similarities(a, b)) >= 0.8):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in rows}


def altered(text, share, seed):
    rng, words = random.Random(seed), text.split()
    for at in rng.sample(range(len(words)), max(1, int(share * len(words)))):
        words[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_similarity_matches_its_definition():
    for seed in range(6):
        a = prose(seed, 40) + " " + prose(seed, 12) * (seed % 3)
        b = altered(a, 0.05 * (seed + 1), seed)
        (x,), (y,) = neardup._sets(pa.array([a]), 5), neardup._sets(pa.array([b]), 5)
        assert np.allclose(neardup.similarity(x, y)[:2], both_similarities(counts_of(a), counts_of(b)))


def test_signatures_estimate_probability_jaccard():
    a = prose(1, 150) + " " + " ".join([prose(9, 8)] * 6)
    texts = [a, altered(a, 0.02, 1), altered(a, 0.1, 2)]
    ((first, last, tokens),) = list(token_chunks(pa.array(texts)))
    signature = neardup.prob_min_hash(*neardup.weighted_shingles(*shingles(tokens, 3, 5)), last - first, 4096)
    for k in (1, 2):
        want = both_similarities(counts_of(texts[0]), counts_of(texts[k]))[1]
        assert abs((signature[0] == signature[k]).mean() - want) < 0.04


def test_classes_match_all_pairs(spark, documents_of):
    rows = []
    for group in range(14):
        base = prose(100 + group, 120)
        rows += [(1000 - 20 * group - k, base if k == 0 else altered(base, 0.002 * k * group, 31 * group + k)) for k in range(6)]
    rows += [(2000 + k, prose(100 + k, 120)) for k in range(4)] + [(2100, "short text"), (2101, "short text"), (2102, "Short, text!")]
    found = neardup.classes(documents_of([(i, t, "a") for i, t in rows]))
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == brute_classes(rows)


def test_a_large_group_of_copies_is_one_class(spark, documents_of):
    base = prose(7, 100)
    rows = [(k, altered(base, 0.01, k), "a") for k in range(400)] + [(500 + k, base, "b") for k in range(300)]
    got = {r["class_id"] for r in neardup.classes(documents_of(rows)).collect()}
    assert got == {0}


def test_a_chain_and_a_passage_that_many_share(spark, documents_of):
    """Links go through a chain; a long shared passage alone links nothing."""
    words = prose(21, 100).split()
    chain = [" ".join(words[k * 4:] + [f"tail{j}" for j in range(k * 4)]) for k in range(8)]
    passage = prose(50, 90)
    rows = [(k + 1, t) for k, t in enumerate(chain)] + [(100 + k, passage + " " + prose(300 + k, 60)) for k in range(60)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(documents_of([(i, t, "a") for i, t in rows])).collect()}
    assert got == brute_classes(rows)


def test_a_passage_that_one_copy_repeats(spark, documents_of):
    """J stays at 0.8 or more and Jp falls far below, so only bands over the plain signature meet these pairs."""
    rows = []
    for group in range(60):
        words = prose(700 + group, 200).split()
        passage, times = words[80:120], (1, 20, 100)[group % 3]
        rows += [(10 * group, " ".join(words)), (10 * group + 1, " ".join(words[:120] + passage * times + words[120:]))]
    sets = [counts_of(t) for _, t in rows]
    pairs = [both_similarities(a, b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert all(j >= 0.8 for j, _ in pairs) and sum(jp < 0.65 for _, jp in pairs) >= 20
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(documents_of([(i, t, "a") for i, t in rows])).collect()}
    missed = sum(got[10 * g + 1] != 10 * g for g in range(60))
    print(f"missed {missed} of 60")
    assert got == brute_classes(rows)


def test_odd_rows(spark, documents_of, odd_rows):
    docs = documents_of(odd_rows)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 9, None: None, 11: 11, 12: 12}
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 2, 4, 5, 6, 7, 8, 9, 11, 12]
    nothing = docs.filter("false")
    assert neardup.classes(nothing).count() == 0 and neardup.keep_one(nothing).count() == 0


def test_keep_one_goes_by_text(spark, documents_of):
    """A second text of an id survives, copies under null ids go, and a class keeps its smallest id."""
    a, b, c, d = (prose(800 + k, 80) for k in range(4))
    rows = [(1, a, "s"), (5, a, "s"), (5, b, "s"), (7, c, "s"), (7, d, "s"), (None, d, "s"), (None, prose(900, 80), "s"), (None, prose(900, 80), "s")]
    kept = sorted(((r["doc_id"] or 0, r["text"]) for r in neardup.keep_one(documents_of(rows)).collect()))
    assert kept == sorted([(1, a), (5, b), (7, c), (7, d), (0, prose(900, 80))])


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").unionAll(spark.sql("select 900L as a, 800L as b"))
    got = {r["node"]: r["label"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 800: 800, 900: 800}


def test_null_texts_are_not_their_lookalikes(spark):
    docs = spark.createDataFrame([(17, None), (18, "null 17"), (19, "n17"), (20, "17"), (None, "t"), (21, "t")], "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect() if r["doc_id"] is not None}
    assert found == {17: 17, 18: 18, 19: 19, 20: 20, 21: 21}
    assert sorted(str(r["text"]) for r in neardup.keep_one(docs).collect()) == ["17", "None", "n17", "null 17", "t"]
