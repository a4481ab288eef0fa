"""Token ids packed into rows of a fixed width by best-fit decreasing.

Texts are tokenized with a public byte-level BPE vocabulary (a file given by path, ranks in tiktoken form).

A document longer than the width is split into full rows and a rest, losslessly: a segment knows its document and its first token. Segments of
a lot are placed longest first, each in the row with the least room that still holds it. A segment tree over the room values
finds that row in O(log width). A row holds the ids (padded), cumulative segment lengths and position ids that
start at 0 in each segment, as little-endian binary matrices.

A lot is what a task reads, cut at LOT_TOKENS, so nothing is shuffled, memory is bounded and no key can be hot; only the last rows of
a lot have more than a little padding.

Edge cases: null and empty texts have no segment and appear with n_tokens 0 in no row; a null doc_id stays null in the
list of its row; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from importlib.util import find_spec
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 2_048
LOT_TOKENS = 2_000_000
#: The split pattern of this vocabulary family, a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PART_CHARS = 1 << 20
_CUT = re.compile(r"\S \S")


def default_vocabulary() -> str:
    """The byte-level BPE of the installed public tokenizers, or its usual folder."""
    spec = find_spec("public_tokenizers")
    folder = Path(spec.origin).parent if spec is not None and spec.origin else Path("/opt/tokenizers")
    return str(folder / "byte_bpe_50k.tiktoken")


def encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokenizer:
    """Whole-text token ids; a very long text is encoded in parts that end where the pre-tokenizer cuts anyway."""

    def __init__(self, path: str):
        made = encoding(path)
        self.encode, self.largest = made.encode_ordinary, made.max_token_value

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= PART_CHARS:
            return np.array(self.encode(text), dtype=np.int32)
        found, at = [], 0
        while at < len(text):
            to = len(text) if len(text) - at <= 2 * PART_CHARS else self._cut(text, at + PART_CHARS)
            found.append(np.array(self.encode(text[at:to]), dtype=np.int32))
            at = to
        return np.concatenate(found)

    @staticmethod
    def _cut(text: str, start: int) -> int:
        """The next single blank between characters that are no white space: a token begins there."""
        found = _CUT.search(text, start)
        return found.start() + 1 if found else len(text)


class Rooms:
    """A segment tree over room values 0..width: how many open rows have that room."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) with the least room of at least ``least``."""
        at = least + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, width: int) -> np.ndarray:
    """The row of each segment; a segment is at most ``width`` long."""
    row_of, rooms, rows = np.empty(len(lengths), dtype=np.int64), Rooms(width), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = rooms.take(n)
        room, row = found if found is not None else (width, rows)
        rows += found is None
        row_of[i] = row
        if room > n:
            rooms.add(room - n, row)
    return row_of


SCHEMA = (
    "part int, lot int, row int, n_tokens int, id_bytes int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"
)
_ARROW = pa.schema([
    ("part", pa.int32()), ("lot", pa.int32()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("id_bytes", pa.int32()), ("ids", pa.binary()), ("positions", pa.binary()),
    ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])


def packed_rows(doc_ids: list, ids: np.ndarray, cuts: np.ndarray, width: int, pad: int, part: int, lot: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """The rows of one lot: text i has the ids cuts[i]..cuts[i + 1]."""
    length = np.diff(cuts)
    pieces = -(-length // width)
    doc = np.repeat(np.arange(len(length)), pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * width
    size = np.minimum(length[doc] - start, width)
    row_of = best_fit_decreasing(size, width)
    order = np.argsort(row_of, kind="stable")
    bounds = np.searchsorted(row_of[order], np.arange(row_of.max() + 2 if len(row_of) else 1))
    for at in range(0, len(bounds) - 1, 512):
        columns: list[list] = [[] for _ in _ARROW]
        for row in range(at, min(at + 512, len(bounds) - 1)):
            mine = order[bounds[row]:bounds[row + 1]]
            matrix, place = np.full(width, pad, dtype=dtype), np.zeros(width, dtype=dtype)
            cu = np.concatenate(([0], np.cumsum(size[mine])))
            for s, to in zip(mine.tolist(), cu[:-1].tolist(), strict=True):
                source = cuts[doc[s]] + start[s]
                matrix[to:to + size[s]] = ids[source:source + size[s]]
                place[to:to + size[s]] = np.arange(size[s])
            values = [part, lot, row, int(cu[-1]), matrix.itemsize, matrix.tobytes(), place.tobytes(), cu.tolist(), [doc_ids[d] for d in doc[mine].tolist()], start[mine].tolist()]
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, vocabulary: str | None = None, width: int = WIDTH, pad: int = 0, lot_tokens: int = LOT_TOKENS) -> DataFrame:
    """Packed rows of all texts; ids and positions are matrices of one row of unsigned integers of ``id_bytes`` bytes.

    Two bytes if the largest id of the vocabulary, the pad and the width fit, else four.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, lot, tokenizer = context.partitionId() if context is not None else 0, 0, Tokenizer(path)
        dtype = "<u2" if max(tokenizer.largest, pad, width - 1) < 1 << 16 else "<u4"
        held_ids, held, lengths, total = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            cuts = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
            yield from packed_rows(held_ids, np.concatenate(held) if held else np.zeros(0, np.int32), cuts, width, pad, part, lot, dtype)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = tokenizer.ids(text.as_py() or "")
                held_ids.append(doc_id)
                held.append(ids)
                lengths.append(len(ids))
                total += len(ids)
                if total >= lot_tokens:
                    yield from flush()
                    held_ids, held, lengths, total, lot = [], [], [], 0, lot + 1
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def unpack(rows: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every segment, to read the matrices back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], dtype=f"<u{row['id_bytes']}")
                for k, doc in enumerate(row["doc_ids"]):
                    out[0].append(doc)
                    out[1].append(row["starts"][k])
                    out[2].append(ids[row["cu_seqlens"][k]:row["cu_seqlens"][k + 1]].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return rows.mapInArrow(run, "doc_id long, start long, ids array<int>")


def write_matrices(rows: DataFrame, path: str) -> None:
    """Packed rows as matrix files: Parquet, ordered by (part, lot, row); the ids of a file are one matrix of fixed width, row after row.

    A lost task writes its file again; half written files are never seen.
    """
    rows.sortWithinPartitions("part", "lot", "row").write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_matrix(file: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, positions), rows x width, of one file that ``write_matrices`` wrote, for a training loop without Spark."""
    import pyarrow.parquet as pq

    table = pq.read_table(file, columns=["id_bytes", "ids", "positions"])
    if not table.num_rows:
        return np.zeros((0, 0), "<u2"), np.zeros((0, 0), "<u2")
    kind = f"<u{table.column('id_bytes')[0].as_py()}"
    ids, positions = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=kind).reshape(table.num_rows, -1) for c in ("ids", "positions"))
    return ids, positions
