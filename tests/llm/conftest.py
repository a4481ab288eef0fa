import random

import pytest

WORDS = [f"{a}{b}" for a in "ba ke li mo nu pa re si to vu".split() for b in "ran del mis tor kan fel".split()]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def documents_of(spark):
    """Documents from (doc_id, text, source) rows, with columns whose names the operators use themselves."""

    def make(rows):
        extra = "size long, target double, score double, bucket long, row int, label int, shard long, part int, key string, digest string, n int, _kept long"
        values = [(i, t, "en", s, None if t is None else len(t), 1, 2.0, 3.0, 4, 5, 6, 7, 8, "k", "d", 9, 10) for i, t, s in rows]
        return spark.createDataFrame(values, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank, tiny and very long texts, ties and repeated rows."""
    long_text = prose(1, 60_000)
    return [
        (1, None, "a"), (2, "", "a"), (3, "", "b"), (4, "   \n\t ", None), (5, "x", "a"), (6, "two words", "b"), (7, long_text, "a"),
        (8, "é à ü 漢字 \U0001f600 " * 30, "b"), (9, prose(2, 200), "a"), (9, prose(2, 200), "a"), (10, prose(2, 200), None), (None, prose(3, 50), "a"),
        (None, None, None), (11, "z" * 5_000, "c"), (12, prose(4, 300), "c"),
    ]


@pytest.fixture(scope="session")
def empty_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
