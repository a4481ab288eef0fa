"""Conversation structure repair: the cheapest edits that make role initials read ``(s?(ua)+)?``.

Rows of a conversation stand by turn (nulls first; ties: role, then SHA-256 of role and text). Each row has at most one fault: blank
(no word character at all), duplicate (role and text seen earlier), truncated (its last character that is no white space
is none of ``.!?``). Edits: Keep costs 0, Rerole to user or assistant 2, Delete 3 (the only edit of blank and duplicate rows), Insert
an empty user or assistant row 2; a truncated row that stays adds 1. Among the cheapest, the edit initials that are least in ASCII order win.

A conversation becomes a signature, one symbol per row: the role initial, in capitals if truncated, or ``x`` if the row must
go. What a suffix of a signature costs depends on the suffix and the grammar state only, so suffixes are shared by all conversations: the
distinct signatures, read from the end, are dealt by range and sorted, which makes neighbours share their nodes. A task walks
them as an acyclic word graph and keeps the nodes of the current suffix chain on a stack: each distinct suffix is solved once,
for its four grammar states, into the cost to go and the first letter of the best audit; the node of the shorter suffix holds the rest.

Texts are shuffled once, to be hashed in order. Inside a task rows come sorted, so a conversation of any length is
streamed with a state of one symbol a row; its hash is sequential by nature, so a conversation stays in one task.

Edge cases: null roles and texts, and null ids inside the drawn fault, are one blank; rows of null conv_id form one conversation; roles
count by their first character, other roles than s, u, a can only be reroled or deleted; a conversation that lost all rows
is returned with zeros, an empty audit and the hash of the empty text; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.tables import materialize

#: Grammar states: at the start, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role initial that an insertion or a new role takes in each state, and the state after it.
WANTED = ("u", "u", "a", "u")
AFTER = (USER, USER, ASSISTANT, USER)
NAMES = {"u": "user", "a": "assistant"}
MAY_END = (START, ASSISTANT)
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
MUST_GO = "x"
_SPACE = " \t\n\x0b\x0c\r"
_ORDER = ["turn", "role", "identity", "copy"]
_KEEPS = {(START, "s"): SYSTEM} | {(state, WANTED[state]): AFTER[state] for state in range(4)}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, lost): seeded faults by crc32 of ``conv_id:turn`` modulo 20.

    0 loses the row (it stays marked, so that its conversation is not forgotten), 1 empties the text, 2 takes its end marks, 3 repeats
    the row, 4 makes the role user.
    """
    blank = F.lit(" ")
    draw = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("draw") == 0).alias("lost"))


def _identified(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text[, copy, lost]) with the identity of role and text."""
    if "copy" not in rows.columns:
        rows = rows.withColumn("copy", F.lit(0)).withColumn("lost", F.lit(False))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.withColumn("identity", key)


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal) of each conversation, from rows without texts."""
    named = _identified(rows)
    last = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    narrow = named.select("conv_id", "turn", F.when(~F.col("lost"), F.substring("role", 1, 1)).alias("initial"), "role", "identity", "copy", last.alias("last"), "lost")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "lost", "identity").orderBy("turn", "copy")) > 1
    fault = F.when(F.col("last") == "", "b").when(earlier, "d").when(~F.col("last").isin(".", "!", "?"), "t").otherwise("")
    sorted_rows = (
        narrow.repartition("conv_id").withColumn("fault", fault).sortWithinPartitions("conv_id", *_ORDER)
        .select("conv_id", "turn", "initial", "fault", "lost"))
    key = rows.schema["conv_id"].dataType.simpleString()
    schema_of = lambda conv: pa.schema([("conv_id", conv), ("signature", pa.string())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, open_, out, kind = None, False, [], pa.int64()
        symbols: list[str] = []
        counts = {"b": 0, "d": 0, "t": 0}
        lowest = highest = None
        turns = illegal = 0
        before = None

        def closed() -> tuple:
            gaps = 0 if lowest is None else highest - lowest + 1 - turns
            return current, "".join(symbols), gaps, counts["b"], counts["d"], counts["t"], illegal

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            schema = schema_of(kind)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, turn, initial, fault, lost in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not open_ or conv != current:
                    if open_:
                        out.append(closed())
                    current, open_, symbols, counts = conv, True, [], {"b": 0, "d": 0, "t": 0}
                    lowest = highest = before = None
                    turns = illegal = 0
                if lost:
                    continue
                if turn is not None and turn != highest:
                    lowest, highest, turns = turn if lowest is None else lowest, turn, turns + 1
                if before is not None and before + initial not in ("su", "ua", "au"):
                    illegal += 1
                before = initial
                if fault:
                    counts[fault] += 1
                letter = initial if initial in ("s", "u", "a") else "o"
                symbols.append(MUST_GO if fault in ("b", "d") else letter.upper() if fault else letter)
            if len(out) >= 4_096:
                yield batch_of(out)
                out = []
        if open_:
            out.append(closed())
        if out:
            yield batch_of(out)

    return sorted_rows.mapInArrow(run, f"conv_id {key}, signature string, gaps long, blank long, duplicate long, truncated long, illegal long")


#: A node: (cost to go, first audit letter) for each grammar state.
Node = tuple[tuple[int, str], ...]


def _with_insertions(best: list[tuple[int, str] | None]) -> Node:
    """The node after allowing insertions before the first row; three in a row never pay."""
    for _ in range(3):
        for state in range(4):
            target = best[AFTER[state]]
            if target is not None:
                option = (target[0] + INSERT, "I")
                best[state] = option if best[state] is None else min(best[state], option)
    return tuple(best)


def last_node() -> Node:
    """The node of the empty suffix."""
    return _with_insertions([(0, "") if state in MAY_END else None for state in range(4)])


def node_before(symbol: str, rest: Node) -> Node:
    """The node of symbol + suffix from the node of the suffix; letters of one state differ, so ties are settled by the letter."""
    best: list[tuple[int, str] | None] = []
    for state in range(4):
        options = [(rest[state][0] + DELETE, "D")]
        if symbol != MUST_GO:
            extra, role = CUT_OFF * symbol.isupper(), symbol.lower()
            options.append((rest[AFTER[state]][0] + REROLE + extra, "R"))
            if (state, role) in _KEEPS:
                options.append((rest[_KEEPS[state, role]][0] + extra, "K"))
        best.append(min(options))
    return _with_insertions(best)


def audit_of(signature: str, nodes: list[Node]) -> str:
    """The best audit from the start; nodes[k] is the node of the last k symbols."""
    state, left, letters = START, len(signature), []
    while True:
        letter = nodes[left][state][1]
        if not letter:
            return "".join(letters)
        letters.append(letter)
        if letter in "IR":
            state = AFTER[state]
        elif letter == "K":
            state = _KEEPS[state, signature[-left].lower()]
        left -= letter != "I"


def solve(found: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct signature."""
    reversed_ = found.select("signature").distinct().withColumn("from_end", F.reverse("signature"))
    sorted_rows = reversed_.repartitionByRange("from_end").sortWithinPartitions("from_end").select("from_end")
    schema = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, chain = [last_node()], ""
        #: Nodes of equal behaviour are one: the step from a node by a symbol is computed once.
        steps: dict[tuple[str, Node], Node] = {}
        for batch in batches:
            out = []
            for text in batch.column("from_end").to_pylist():
                shared = 0
                for a, b in zip(chain, text, strict=False):
                    if a != b:
                        break
                    shared += 1
                del nodes[shared + 1:]
                for symbol in text[shared:]:
                    rest = nodes[-1]
                    # Costs are kept relative to the cheapest state, so that equal nodes meet whatever lies behind them.
                    low = min(c for c, _ in rest)
                    key = (symbol, tuple(c - low for c, _ in rest))
                    made = steps.get(key)
                    if made is None:
                        made = steps[key] = node_before(symbol, tuple((c, "") for c in key[1]))
                    nodes.append(tuple((c + low, letter) for c, letter in made))
                chain = text
                signature = text[::-1]
                out.append((signature, nodes[-1][START][0], audit_of(signature, nodes)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return sorted_rows.mapInArrow(run, "signature string, cost long, audit string")


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation."""
    found = materialize(signatures(rows))
    return found.join(solve(found), "signature").drop("signature")


class Repair:
    """The repaired rows of one conversation, one after the other."""

    def __init__(self, audit: str):
        self.letters, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the rows to insert here."""
        while self.letters[self.at:self.at + 1] == "I":
            yield "I", NAMES[WANTED[self.state]], ""
            self.state, self.at = AFTER[self.state], self.at + 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "R":
            yield letter, NAMES[WANTED[self.state]], text
            self.state = AFTER[self.state]
        elif letter == "K":
            yield letter, role, text
            self.state = _KEEPS[self.state, role[:1]]


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _streamed(rows: DataFrame) -> tuple[DataFrame, str]:
    """Rows in repaired order of reading: a head with the audit first, then the rows of the conversation; and the type of its id."""
    heads = audits(rows).withColumn("head", F.lit(0))
    named = _identified(rows).filter(~F.col("lost")).withColumn("head", F.lit(1)).drop("lost")
    both = heads.unionByName(named, allowMissingColumns=True)
    columns = ["conv_id", "head", "audit", *_REPORT, "role", "text"]
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "head", *_ORDER).select(columns), rows.schema["conv_id"].dataType.simpleString()


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of the rows after repair, place from 0."""
    streamed, key = _streamed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, current, place = None, None, 0
        for batch in batches:
            out: list[tuple] = []

            def emit(made: Iterator[tuple[str, str, str]]) -> None:
                nonlocal place
                for edit, role, text in made:
                    out.append((current, place, edit, role, text))
                    place += 1

            for conv, head, audit, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "head", "audit", "role", "text")], strict=True):
                if head == 0:
                    if repair is not None:
                        emit(repair.inserted())
                    repair, current, place = Repair(audit), conv, 0
                else:
                    emit(repair.row(role, text))
            yield _rows_of(out, batch)
        if repair is not None:
            out = [(current, place + k, *made) for k, made in enumerate(repair.inserted())]
            yield _rows_of(out, batch)

    def _rows_of(out: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "place", "edit", "role", "text"])

    return streamed.mapInArrow(run, f"conv_id {key}, place long, edit string, role string, text string")


def report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    The hash is that of the repaired rows as ``role:text``, joined by newlines.
    """
    streamed, key = _streamed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_row, repair, digest, fresh = None, None, None, True

        def add(made: Iterator[tuple[str, str, str]]) -> None:
            nonlocal fresh
            for _, role, text in made:
                digest.update(f"{'' if fresh else chr(10)}{role}:{text}".encode())
                fresh = False

        def closed() -> tuple:
            add(repair.inserted())
            return (*head_row, digest.hexdigest())

        for batch in batches:
            out = []
            kinds = [batch.schema.field(c).type for c in ("conv_id", *_REPORT, "audit")] + [pa.string()]
            names = ["conv_id", *_REPORT, "audit", "repaired_sha256"]
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for i, head in enumerate(columns["head"]):
                if head == 0:
                    if repair is not None:
                        out.append(closed())
                    head_row = tuple(columns[c][i] for c in names[:-1])
                    repair, digest, fresh = Repair(columns["audit"][i]), hashlib.sha256(), True
                else:
                    add(repair.row(columns["role"][i], columns["text"][i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if repair is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(closed(), kinds, strict=True)], names)

    counts = ", ".join(f"{c} long" for c in _REPORT)
    return streamed.mapInArrow(run, f"conv_id {key}, {counts}, audit string, repaired_sha256 string").select(
        "conv_id", *_REPORT, "audit", "repaired_sha256")
