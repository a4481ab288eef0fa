import os
import random

import numpy as np
import pyarrow as pa
import pytest

from tapeloom.llm import quality, toxicity
from tapeloom.llm.tables import held_out, read

from .conftest import prose

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def test_factorization_machine_learns_a_pair(spark, documents_of):
    """Neither word is harmful alone: a linear score cannot tell them apart, the pairwise part can."""
    rng, rows, labels = random.Random(1), [], []
    for i in range(600):
        insult, group = i % 2, (i // 2) % 2
        words = [prose(i, 20), "vermin" if insult else "", "martians" if group else ""]
        rng.shuffle(words)
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 1, insult & group))
    docs, marks = documents_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = model.scores(pa.array(["the vermin ran", "the martians ran", "vermin martians", "nothing", ""]))
    assert (got[[0, 1, 3, 4]] < 0.5).all() and got[2] > 0.5


def test_terms_that_matter_only_together(spark, documents_of):
    """Toxic with exactly one of two words, beside many words that are toxic by themselves in other documents."""
    rng, rows, labels = random.Random(2), [], []
    for i in range(1200):
        if i % 3 == 2:
            words, toxic = [prose(i, 20), f"plainly{'abcdefghijklmnopqrstuvwxy'[i % 25]}" if i % 2 else ""], i % 2
        else:
            one, two = rng.random() < 0.5, rng.random() < 0.5
            words, toxic = [prose(i, 20), "copper" if one else "", "lantern" if two else ""], int(one != two)
        rng.shuffle(words)
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 1, toxic))
    docs, marks = documents_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = model.scores(pa.array(["a copper pan", "the lantern burns", "copper lantern", "plainlya said"]))
    assert got[0] > 0.5 and got[1] > 0.5 and got[2] < 0.5 and got[3] > 0.5


def test_interactions_match_the_definition():
    rng = np.random.default_rng(3)
    one, two = ((rng.random((300, k)) < 0.4).astype(np.float32) for k in (3, 2))
    residual = rng.normal(size=300).astype(np.float32)
    got = toxicity.interactions(one, two, residual)
    for a in range(3):
        for b in range(2):
            contrast = variance = 0.0
            for x in (0, 1):
                for z in (0, 1):
                    cell = residual[(one[:, a] == x) & (two[:, b] == z)]
                    contrast += (1 if x == z else -1) * cell.sum() / (len(cell) + 1)
                    variance += ((cell**2).sum() + (residual**2).mean()) / (len(cell) + 1) ** 2
            assert np.isclose(got[0][a, b], abs(contrast), rtol=1e-3, atol=1e-4)
            assert np.isclose(got[1][a, b], abs(contrast) / np.sqrt(variance), rtol=1e-3, atol=1e-4)


def test_logits_match_the_definition():
    rng = np.random.default_rng(0)
    model = toxicity.FactorizationMachine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    slots = [0, 2, 5]
    want = 0.3 + model.w[slots].sum() + sum(model.v[a] @ model.v[b] for k, a in enumerate(slots) for b in slots[:k])
    assert np.allclose(model.logits(np.zeros(3, dtype=int), np.array(slots), 1), want)


@pytest.mark.parametrize(("module", "label", "least", "cut"), [(toxicity, "toxic", 0.8, 0.5), (quality, "quality", 0.97, 0.3)])
def test_held_out_rows(spark, module, label, least, cut):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = module.train(docs, labels)
    rows = docs.select("doc_id", held_out().alias("h"), module.score(model).alias("score")).join(labels, "doc_id").filter("h").toPandas()
    score, truth = rows["score"].to_numpy(), rows[label].to_numpy()
    assert auc(score, truth) >= least and ((score >= 0) & (score <= 1)).all()
    clean = truth == (0 if label == "toxic" else 1)
    assert ((score >= cut) == (truth == 1))[clean].mean() > 0.97


@pytest.mark.parametrize("module", [toxicity, quality])
def test_reruns_agree(spark, module):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    texts = pa.array([r["text"].lower() for r in docs.limit(50).collect()])
    one, two = module.train(docs, labels), module.train(docs.repartition(5), labels.repartition(3))
    assert np.allclose(one.scores(texts), two.scores(texts), atol=1e-6)


@pytest.mark.parametrize(("module", "label", "without"), [(toxicity, "toxic", 0.0), (quality, "quality", 1.0)])
def test_odd_rows(spark, documents_of, odd_rows, empty_labels, module, label, without):
    docs = documents_of(odd_rows)
    for table in (docs, docs.filter("false")):
        model = module.train(table, empty_labels)
        got = table.select("*", module.score(model).alias("found")).collect()
        assert len(got) == table.count() and all(r["found"] == without for r in got)
    one_class = spark.createDataFrame([(i, 1, 1) for i in range(13)], "doc_id long, quality int, toxic int")
    got = docs.select(module.score(module.train(docs, one_class)).alias("found")).collect()
    assert len(got) == len(odd_rows) and all(0.5 < r["found"] < 1 for r in got)
    mixed = spark.createDataFrame([(i, i % 2, i % 2) for i in range(13)] + [(None, 1, 1), (5, None, None), (6, 1, 1)], "doc_id long, quality int, toxic int")
    model = module.train(docs, mixed)
    got = docs.select("doc_id", module.score(model).alias("found")).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["found"] <= 1 for r in got)


def test_word_vectors_cover_every_document(spark, documents_of):
    rows = [(i, prose(i, 30), "a") for i in range(40)]
    whole = quality.context_counts(iter([pa.array([t for _, t, _ in rows])]))
    place, sign = quality.index_vectors()
    direct = np.zeros_like(whole)
    for _, t, _ in rows:
        for first, _, text, bucket in quality._token_buckets(pa.array([t])):
            for i in range(len(bucket)):
                for j in range(max(0, i - 2), min(len(bucket), i + 3)):
                    if i != j:
                        np.add.at(direct[bucket[i]], place[bucket[j]], sign[bucket[j]])
    assert (whole == direct).all()
    one, two = quality.word_vectors(documents_of(rows)), quality.word_vectors(documents_of(rows).repartition(7))
    assert (one == two).all()
