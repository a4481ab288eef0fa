"""SentencePiece encoding and decoding with a merge-type (BPE) model, exactly as the library does it.

A model of this type merges, again and again, the neighbouring pair whose union has the best score (ties: the leftmost). The same
ids are found without merging the whole text: an Aho-Corasick automaton gives the longest piece that begins at each
character, pieces are laid from left to right, a piece may follow another only if merging the characters of the two gives these two
again, and where nothing fits the last piece is taken back and replaced by its next shorter prefix. The encoding of a prefix is unique,
so a position from which nothing fits never needs a second visit; such positions are kept in a bitfield, and the time is linear.

Pieces hold the mark of a blank only at their beginning, so a text falls apart, before each run of blanks, into chunks
(a model with other pieces takes the text as one chunk), and a chunk wherever its two next characters stand side by side in no piece.
These parts are encoded on their own; those met before come from a bounded table.

Edge cases: null and empty texts have the begin and end ids only and decode to the empty text; characters without a piece become byte
pieces; a blank mark in the text itself counts as a blank, as in the library; a null doc_id stays null; repeated rows are encoded as
often as they occur; other columns are not read.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Bounds of the tables of a worker.
CHUNKS_KEPT, CHUNK_CHARS, PAIRS_KEPT = 1 << 18, 48, 1 << 20
FLUSH_BYTES = 8 << 20
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def default_model() -> str:
    """The merge-type model of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_NEVER = float("-inf")


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Model:
    """Pieces, scores and settings of a model file, with the tables that encoding fills as it goes."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        source = SentencePieceProcessor(model_file=path)
        if source.normalize("  AÄﬁ  b ") != f"{MARK * 3}AÄﬁ{MARK * 2}b{MARK}":
            raise ValueError(f"{path}: only models that leave the text as it is, with one blank before it, are read here")
        ids = range(source.get_piece_size())
        self.piece = [source.id_to_piece(i) for i in ids]
        special = [source.is_control(i) or source.is_unknown(i) or source.is_byte(i) for i in ids]
        self.id_of = {p: i for i, p in enumerate(self.piece) if not special[i]}
        self.score = {p: source.get_score(i) for p, i in self.id_of.items()}
        self.size = [len(p) for p in self.piece]
        self.byte_id = {int(self.piece[i][3:5], 16): i for i in ids if source.is_byte(i)}
        if len(self.byte_id) < 256 or any(c not in self.id_of for p in self.id_of for c in p):
            raise ValueError(f"{path}: the model needs byte pieces and a piece for each character of its pieces")
        self.begin, self.end = source.bos_id(), source.eos_id()
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.cut_at_blanks = not any(MARK in p.lstrip(MARK) for p in self.id_of)
        #: Two characters that stand side by side in some piece; elsewhere nothing is ever merged.
        self.joined = {p[k:k + 2] for p in self.id_of for k in range(len(p) - 1)}
        self.surface = [
            b"" if source.is_control(i) else " ⁇ ".encode() if source.is_unknown(i)
            else bytes([int(self.piece[i][3:5], 16)]) if source.is_byte(i) else self.piece[i].replace(MARK, " ").encode()
            for i in ids]
        self.control = {i for i in ids if source.is_control(i)}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int] = {}
        self._chunks: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging; text has only characters with a piece."""
        parts, score = list(text), self.score.get
        scores = [score(a + b, _NEVER) for a, b in pairwise(parts)]
        while scores:
            best = max(scores)
            if best == _NEVER:
                break
            at = scores.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], _NEVER)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], _NEVER)
        return parts

    def _fits(self, before: int, piece: int) -> bool:
        """Whether merging gives these two neighbours again; before -1: whether the piece alone comes out of merging."""
        if len(self._pairs) >= PAIRS_KEPT:
            self._pairs.clear()
        wanted = [self.piece[piece]] if before < 0 else [self.piece[before], self.piece[piece]]
        known = self._pairs[before, piece] = self.merge("".join(wanted)) == wanted
        return known

    def shorter(self, piece: int) -> int:
        """The longest piece that is a proper prefix, or -1."""
        found = self._shorter.get(piece)
        if found is None:
            text = self.piece[piece]
            found = self._shorter[piece] = next((self.id_of[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.id_of), -1)
        return found

    def _lay(self, longest: list[int]) -> list[int]:
        """Ids over a stretch whose characters all have a piece; longest: the longest piece from each character."""
        n, at, laid, before = len(longest), 0, [], -1
        failed = bytearray(n // 8 + 1)
        size, known = self.size, self._pairs.get
        piece = longest[0]
        while at < n:
            while piece >= 0:
                to = at + size[piece]
                if not failed[to >> 3] >> (to & 7) & 1:
                    fits = known((before, piece))
                    if self._fits(before, piece) if fits is None else fits:
                        break
                piece = self.shorter(piece)
            if piece >= 0:
                laid.append(piece)
                at, before = to, piece
                piece = longest[at] if at < n else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                taken = laid.pop()
                at -= size[taken]
                piece, before = self.shorter(taken), laid[-1] if laid else -1
        return laid

    def _part(self, text: str) -> bytes:
        """Ids of characters that may all be joined, or of one character without a piece."""
        whole = self.id_of.get(text)
        if whole is None and len(text) == 1:
            return _packed([self.byte_id[b] for b in text.encode()])
        longest, size = [-1] * len(text), self.size
        for end, piece in self.automaton.iter(text):
            # Ends only grow, so the last piece seen from a character is the longest.
            longest[end + 1 - size[piece]] = piece
        return _packed(self._lay(longest))

    def _chunk(self, text: str) -> bytes:
        """Ids of a chunk; no piece lies across two characters that are neighbours in no piece, so the chunk is cut there."""
        joined, cuts = self.joined, [0]
        for i in range(1, len(text)):
            if text[i - 1:i + 1] not in joined:
                cuts.append(i)
        if len(cuts) == 1:
            return self._part(text)
        return b"".join([self._known(text[a:b], self._part) for a, b in pairwise([*cuts, len(text)])])

    def _known(self, text: str, make: Callable[[str], bytes]) -> bytes:
        """The ids of a stretch of text, from the table or made and kept there."""
        found = self._chunks.get(text)
        if found is None:
            found = make(text)
            if len(text) <= CHUNK_CHARS:
                if len(self._chunks) >= CHUNKS_KEPT:
                    self._chunks.clear()
                self._chunks[text] = found
        return found

    def encode(self, text: str, begin: bool = True, end: bool = True) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        marked = MARK + text.replace(" ", MARK) if text else ""
        chunks = _CHUNK.findall(marked) if self.cut_at_blanks else [marked] if marked else []
        found = list(map(self._chunks.get, chunks))
        if None in found:
            found = [self._known(c, self._chunk) if f is None else f for f, c in zip(found, chunks, strict=True)]
        return b"".join([_packed([self.begin]) if begin else b"", *found, _packed([self.end]) if end else b""])

    def decode(self, ids: bytes) -> str:
        """The text of ids; the blank before the first piece is taken off, bytes that are no UTF-8 become U+FFFD one by one."""
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        stretches: list[list[int]] = [[]]
        if self.control.isdisjoint(numbers[1:-1]):
            stretches[0] = numbers
        else:
            for i in numbers:
                if i in self.control:
                    stretches.append([])
                else:
                    stretches[-1].append(i)
        first = next((i for i in numbers if i not in self.control), None)
        # Byte pieces on two sides of a control piece never form one character.
        text = "".join(b"".join(map(self.surface.__getitem__, s)).decode("utf-8", "each_byte") for s in stretches)
        return text[1:] if first is not None and self.piece[first].startswith(MARK) else text


@lru_cache(maxsize=2)
def model_of(path: str) -> Model:
    """One model per worker process and file."""
    return Model(path)


def _flushed(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Batches of a few megabytes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= FLUSH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def encode(docs: DataFrame, model: str | None = None, begin: bool = True, end: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids) of each whole text; ids are little-endian unsigned 32-bit integers."""
    path = model or default_model()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model_of(path)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    ids = coder.encode(text.as_py() or "", begin, end)
                    yield doc_id, len(ids) // 4, ids

        yield from _flushed(rows(), schema, lambda row: len(row[2]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, text) of rows as ``encode`` gives them; null ids decode to the empty text."""
    path = model or default_model()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model_of(path)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                numbers = zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids"), strict=True)
                for doc_id, n, ids in numbers:
                    ids = ids.as_py()
                    yield doc_id, n, ids, coder.decode(ids or b"")

        yield from _flushed(rows(), schema, lambda row: len(row[2] or b"") + len(row[3]))

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def round_trip_report(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document."""
    both = decode(encode(docs, model), model)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
