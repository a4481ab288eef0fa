import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import sentencepieces

from .conftest import prose

PATH = sentencepieces.default_model()


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return sentencepieces.Model(PATH)


def same(library, model, text):
    want = library.encode(text, add_bos=True, add_eos=True)
    got = model.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want, repr(text)
    assert model.decode(got) == library.decode(want), repr(text)


def test_chosen_texts(library, model):
    texts = [
        "", " ", "  ", "a", " a", "a ", "Hello  world\n\tx", "▁", "x▁y ▁", "<s></s><unk><0x41>", "\x00\x01", "a\r\nb", "ﬁ Ä é",
        "漢字かな交じり文の例です。", "\U0001f600\U0001f9d1‍\U0001f680", "ababababab" * 20, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 77, "0123456789" * 9,
        "�﻿ ", "ééééàààà ùùù", "नमस्ते दुनिया", "العربية", "code: for (int i=0;i<n;++i){}",
    ]
    texts += [" " * n + tail for n in range(0, 70) for tail in ("", "the", "x" * 3, "\n")]
    texts += ["\n" * n + " " * m + "end" for n in range(6) for m in range(20)]
    for text in texts:
        same(library, model, text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabehtinors  \n.,1▁é漢\U0001f600=-"), max_size=60))
def test_small_alphabets(text):
    same(sentencepieces_library(), sentencepieces.model_of(PATH), text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    same(sentencepieces_library(), sentencepieces.model_of(PATH), text)


def sentencepieces_library(cache=[]):
    if not cache:
        from sentencepiece import SentencePieceProcessor

        cache.append(SentencePieceProcessor(model_file=PATH))
    return cache[0]


def test_glued_pieces_need_backtracking(library, model):
    rng = random.Random(5)
    pieces = [p for p in model.id_of if 2 <= len(p) <= 9]
    for _ in range(1_500):
        same(library, model, "".join(rng.choice(pieces).replace(sentencepieces.MARK, rng.choice(["", " "])) for _ in range(rng.randrange(1, 12))))


def test_bounded_tables_do_not_change_results(library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "CHUNKS_KEPT", 3)
    monkeypatch.setattr(sentencepieces, "PAIRS_KEPT", 5)
    small = sentencepieces.Model(PATH)
    for k in range(5):
        same(library, small, prose(k, 60))
    assert len(small._chunks) <= 3 and len(small._pairs) <= 5


def test_one_chunk_gives_the_same(library):
    whole = sentencepieces.Model(PATH)
    whole.cut_at_blanks = False
    for k in range(4):
        same(library, whole, prose(k, 80) + "  \n" + "é漢 " * k)


def test_decoding_of_any_ids(library, model):
    rng = random.Random(7)
    blank = model.id_of[sentencepieces.MARK]
    for _ in range(1_500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32_000), blank, 1, 2]) for _ in range(rng.randrange(0, 9))]
        assert model.decode(np.array(ids, dtype="<u4").tobytes()) == library.decode(ids), ids


def test_query_columns_on_odd_rows(spark, library, documents_of, odd_rows):
    got = {}
    for r in sentencepieces.round_trip_report(documents_of(odd_rows)).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    want = {}
    for doc_id, text, _ in odd_rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        digest = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        want.setdefault(doc_id, []).append((len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sentencepieces.round_trip_report(documents_of([])).count() == 0
    outputs = {r["doc_id"]: r["text"] for r in sentencepieces.decode(sentencepieces.encode(documents_of(odd_rows))).collect()}
    assert outputs[7] == prose(1, 60_000) and outputs[1] == ""
