import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from tapeloom.llm import fingerprints, textbytes, token_packing, warc
from tapeloom.llm.tables import read

from .conftest import prose


def test_tokens_match_a_regular_expression():
    texts = ["One two, THREE!! é-ü 4x", "", None, "  ", "a", "漢字 b_c", prose(1, 500)]
    pattern = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
    seen = {}
    for first, _, tokens in textbytes.token_chunks(pa.array(texts)):
        for i, text in enumerate(texts):
            words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in pattern.findall(text or "")]
            got = tokens.hash[tokens.text == i - first].tolist()
            assert len(got) == len(words)
            for w, h in zip(words, got, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_a_very_long_text_is_cut_between_words(monkeypatch):
    monkeypatch.setattr(textbytes, "CHUNK_BYTES", 1_000)
    text = prose(3, 3_000)
    cut = [t.hash for _, _, t in textbytes.token_chunks(pa.array([text]))]
    monkeypatch.setattr(textbytes, "CHUNK_BYTES", 1 << 20)
    whole = [t.hash for _, _, t in textbytes.token_chunks(pa.array([text]))]
    assert (np.concatenate(cut) == np.concatenate(whole)).all()


def brute_report(rows):
    """(doc_id, text) in ring order, by plain Python."""
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = fingerprints.edited_text(t, following)
        own, new, after = fingerprints.digests([t.encode()]), fingerprints.digests([edited.encode()]), fingerprints.digests([following.encode()])
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own[0].tobytes().hex(), new[0].tobytes().hex(),
                    fingerprints.likeness(own, new)[0], fingerprints.likeness(own, after)[0]))
    return out


def test_edited_report_matches_a_ring(spark, documents_of, odd_rows):
    rows = [(i, t, "a") for i, t, _ in odd_rows if i is not None and (i, t) != (9, prose(2, 200))] + [(100 + k, prose(k, 30 + k), "b") for k in range(80)]
    want = brute_report([(i, t or "") for i, t, _ in sorted(rows, key=lambda r: -r[0])])
    for parts in ("3", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = [tuple(r) for r in fingerprints.edited_report(documents_of(rows)).collect()]
        assert sorted(got) == sorted(want)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_fingerprint_edges(spark, documents_of, odd_rows):
    docs = documents_of(odd_rows)
    got = fingerprints.edited_report(docs).collect()
    assert len(got) == len(odd_rows) and fingerprints.edited_report(docs.filter("false")).count() == 0
    same = {r["fingerprint"] for r in got if r["doc_id"] in (9, 10)}
    assert len(same) == 1 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    (alone,) = fingerprints.edited_report(documents_of([(1, "abcdef", "a")])).collect()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and alone["near_next"] == 1.0


def test_digest_by_hand():
    counts = fingerprints._triplet_counts(np.frombuffer(b"abcdabcd", dtype=np.uint8), np.array([0, 4, 4, 8]))
    assert counts.sum(axis=1).tolist() == [2, 0, 2] and (counts[0] == counts[2]).all()
    a, b = fingerprints.digests([prose(1, 400).encode()]), fingerprints.digests([prose(1, 400).encode()])
    far = np.frombuffer(b"\xff\xff" + b"\xff" * 32, dtype=np.uint8)[None], np.frombuffer(b"\x00\x00" + b"\x00" * 32, dtype=np.uint8)[None]
    assert fingerprints.likeness(a, b)[0] == 1.0 and fingerprints.likeness(*far)[0] == 0.0
    assert (fingerprints.from_hex([a[0].tobytes().hex()]) == a).all()


def test_digest_pieces_agree(monkeypatch):
    text = prose(5, 2_000).encode()
    whole = fingerprints.digests([text, b"ab", text[:77]])
    monkeypatch.setattr(fingerprints, "PIECE_BYTES", 100)
    assert (fingerprints.digests([text, b"ab", text[:77]]) == whole).all()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h{i}.test/p", f"<p>{prose(i, 10)}</p>\r\n") for i in range(3_000, 7_000)]
    return spark.createDataFrame([*rows, (None, "http://x.test", "x"), (9, None, None), (9, None, "twice"), (200_000, "", "")], "page_id long, url string, html string")


def test_warc_files_round_trip(spark, pages, tmp_path):
    records = warc.records(pages)
    warc.write_warc(records, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, records.collect()))
    assert warc.audit(records, back).count() == 0
    record = records.filter("record_id = 3000").first()["record"]
    head, _, body = record.partition("\r\n\r\n")
    assert f"Content-Length: {len(body.encode())}" in head


def test_audit_matches_a_direct_comparison(spark, pages):
    left = warc.records(pages)
    right = warc.damaged_copy(left).filter("record_id <> 200000").unionAll(spark.sql("select 5000000L, 'new'"))
    got = {r["record_id"]: r["kind"] for r in warc.audit(left, right).collect()}
    a, b = {}, {}
    for side, rows in ((a, left.collect()), (b, right.collect())):
        for r in rows:
            side.setdefault(r["record_id"], []).append(r["record"])
    want = {
        i: "missing" if i not in b else "extra" if i not in a else "changed"
        for i in a.keys() | b.keys() if sorted(a.get(i, [])) != sorted(b.get(i, []))
    }
    assert got == want and set(want.values()) == {"missing", "extra", "changed"}


def test_audit_places_records_and_takes_empty_replicas(spark, pages):
    left = warc.records(pages)
    places, at = {}, {}
    for r in sorted(left.collect(), key=lambda r: r["record_id"]):
        archive = r["record_id"] // warc.RECORDS_PER_ARCHIVE
        places.setdefault(r["record_id"], at.get(archive, 0))
        at[archive] = at.get(archive, 0) + len(r["record"].encode()) + len(warc.TAIL)
    for r in warc.audit(left, left.filter("false")).collect():
        assert r["kind"] == "missing" and r["offset"] == places[r["record_id"]]
    assert warc.audit(left.filter("false"), left.filter("false")).count() == 0
    assert {r["kind"] for r in warc.audit(left.filter("false"), left).collect()} == {"extra"}


def test_pages_that_hold_record_heads_are_read_by_length(spark, tmp_path):
    nested = warc.HEAD + "7>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a.test/\r\nContent-Length: 1\r\n\r\n", nested * 3), (2, None, nested), (2, "u", "\r\n\r\n"), (None, "é", "漢" * 9)]
    records = warc.records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    warc.write_warc(records, str(tmp_path / "n"))
    assert sorted(map(tuple, warc.read_warc(spark, str(tmp_path / "n")).collect())) == sorted(map(tuple, records.collect()))
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse(b"junk"))


def test_reported_offsets_are_places_in_the_files(spark, pages, tmp_path):
    left = warc.records(pages).dropDuplicates(["record_id"])
    warc.write_warc(left, str(tmp_path / "o"))
    archives = {}
    for folder in (tmp_path / "o").glob("archive=*"):
        archives[int(folder.name.partition("=")[2])] = b"".join(f.read_bytes() for f in sorted(folder.glob("*.txt")))
    by_id = {r["record_id"]: r["record"].encode() for r in left.collect()}
    found = warc.audit(left, warc.damaged_copy(left)).filter("kind <> 'extra'").collect()
    assert len(found) > 50
    for r in found:
        assert archives[r["archive"]][r["offset"]:r["offset"] + r["bytes"]] == by_id[r["record_id"]]


def test_wide_vocabularies_keep_their_ids(spark, documents_of, tmp_path):
    import base64

    # 256 bytes and 70,000 invented ranks: ids beyond 16 bits occur.
    tokens = [bytes([b]) for b in range(256)] + [f"{k:05d}".encode() for k in range(70_000)]
    steps = sorted({t[:n] for t in tokens[256:] for n in range(2, 5)})
    path = tmp_path / "wide.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate([*tokens[:256], *steps, *tokens[256:]])))
    rows = [(k, f"{69_990 + k % 10:05d}" * 4 + " x", "a") for k in range(40)]
    packed = token_packing.pack(documents_of(rows), vocabulary=str(path), width=64)
    assert {r["id_bytes"] for r in packed.collect()} == {4}
    encode = token_packing.encoding(str(path)).encode_ordinary
    got = {r["doc_id"]: r["ids"] for r in token_packing.unpack(packed).collect()}
    assert got == {k: encode(t) for k, t, _ in rows} and max(max(v) for v in got.values()) > 1 << 16


def test_matrix_files_hold_the_rows(spark, documents_of, tmp_path):
    rows = token_packing.pack(documents_of([(k, prose(k, 40 + k), "a") for k in range(60)]).coalesce(2), width=128)
    token_packing.write_matrices(rows, str(tmp_path / "m"))
    want = {(r["ids"], r["positions"]) for r in rows.collect()}
    got = set()
    for file in (tmp_path / "m").glob("*.parquet"):
        ids, positions = token_packing.read_matrix(str(file))
        assert ids.shape == positions.shape and ids.shape[1] == 128
        got |= {(a.tobytes(), b.tobytes()) for a, b in zip(ids, positions, strict=True)}
    assert got == want


def test_packing_round_trip(spark, documents_of, odd_rows):
    docs = documents_of([*odd_rows, *[(1_000 + k, prose(k, 5 + 37 * k % 900), "a") for k in range(150)]])
    rows = token_packing.pack(docs.repartition(3), width=256, lot_tokens=20_000)
    encode = token_packing.encoding(token_packing.default_vocabulary()).encode_ordinary
    back = {}
    for r in token_packing.unpack(rows).collect():
        back.setdefault(r["doc_id"], {}).setdefault(r["start"], []).append(r["ids"])
    for i, t, _ in odd_rows:
        if t and i not in (None, 9):
            assert sum((back[i][s][0] for s in sorted(back[i])), []) == encode(t)
    assert back[9][0][0] == encode(prose(2, 200))[:256] and len(back[9][0]) == 2
    assert not back.keys() & {1, 2, 3}
    for r in rows.collect():
        cu, place = r["cu_seqlens"], np.frombuffer(r["positions"], dtype="<u2")
        assert len(place) == 256 and cu[-1] == r["n_tokens"] <= 256 and len(r["doc_ids"]) == len(cu) - 1 == len(r["starts"])
        assert all(place[a:b].tolist() == list(range(b - a)) for a, b in zip(cu, cu[1:], strict=False)) and not place[cu[-1]:].any()
    assert token_packing.pack(docs.filter("false")).count() == 0


def test_best_fit_decreasing_matches_a_direct_search():
    rng = np.random.default_rng(4)
    for width in (1, 2, 7, 100, 256):
        lengths = rng.integers(1, width + 1, 400)
        got = token_packing.best_fit_decreasing(lengths, width)
        rooms = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [k for k, room in enumerate(rooms) if room >= n]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= n
            else:
                rooms.append(width - n)
        used = np.bincount(got, weights=lengths)
        assert used.max() <= width and sorted(width - used) == sorted(rooms)


def test_long_texts_have_the_ids_of_the_whole(monkeypatch):
    tokenizer = token_packing.Tokenizer(token_packing.default_vocabulary())
    texts = [prose(1, 400), "a  b \n c d " * 200, "x" * 3_000, " ".join("don't" for _ in range(500))]
    want = [tokenizer.encode(t) for t in texts]
    monkeypatch.setattr(token_packing, "PART_CHARS", 50)
    assert [tokenizer.ids(t).tolist() for t in texts] == want


def test_full_rows_on_documents(spark):
    rows = token_packing.pack(read(spark, "/root/testdata/sf0.001", "documents").coalesce(1))
    used, n = rows.selectExpr("sum(n_tokens)", "count(*)").first()
    assert used / (n * token_packing.WIDTH) > 0.95
