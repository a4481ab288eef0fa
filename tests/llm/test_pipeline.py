import corpus_pipeline
import pytest
from tapeloom.llm import neardup, quality, toxicity
from tapeloom.llm.tables import read

from .conftest import prose

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_on_all_rows(spark):
    docs = read(spark, SF, "documents")
    columns, labels = docs.columns, read(spark, SF, "labels")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    def ids(df):
        return {r["doc_id"] for r in df.select("doc_id").collect()}

    clean = stage["toxicity"](spark, docs, SF)
    scores = docs.select("doc_id", toxicity.score(toxicity.train(docs, labels)).alias("s"))
    assert clean.columns == columns and ids(clean) == ids(scores.filter("s < 0.5"))
    good = stage["quality"](spark, clean, SF)
    scores = clean.select("doc_id", quality.score(quality.train(docs, labels, corpus=clean)).alias("s"))
    assert good.columns == columns and ids(good) == ids(scores.filter("s >= 0.3"))
    lone = stage["near_duplicates"](spark, good, SF)
    assert lone.columns == columns and ids(lone) == ids(neardup.classes(good).filter("doc_id = class_id"))
    mixed = stage["mixing"](spark, lone, SF)
    assert mixed.columns == columns and ids(mixed) <= ids(lone)
    packed = stage["packing"](spark, mixed, SF)
    assert ids(packed) == ids(mixed)
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, documents_of, odd_rows, name):
    docs = documents_of([*odd_rows, *[(100 + i, prose(i, 60), "a") for i in range(20)]])
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, SF)
    assert out.count() > 0 and stage(spark, docs.filter("false"), SF).count() == 0
    if name != "packing":
        assert out.columns == docs.columns
