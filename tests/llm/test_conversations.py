import hashlib
import heapq
import random
import re
import zlib

import pytest

from tapeloom.llm import conversations
from tapeloom.llm.tables import read

WORD = re.compile(r"[^\x20\x09-\x0D]")


def brute_damage(rows):
    """Rows (conv_id, turn, role, text) after the drawn faults; the ids of all conversations."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def identity(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute_repair(faults):
    """Cheapest (cost, audit, repaired) over all edit sequences, by a best-first search of (row, initials so far)."""
    legal = {"": "sU", "s": "u", "u": "a", "a": "u"}
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, last, made = heapq.heappop(queue)
        if at == len(faults) and last in ("", "a"):
            return cost, audit, list(made)
        if (at, last) in seen:
            continue
        seen.add((at, last))

        def go(extra, letter, step, role=None, text=None):
            initial = last if role is None else role[:1]
            if role is not None and initial not in legal[last].lower():
                return
            heapq.heappush(queue, (cost + extra, audit + letter, at + step, initial, made if role is None else (*made, (role, text))))

        for role in ("user", "assistant"):
            go(2, "I", 0, role, "")
        if at < len(faults):
            role, text, fault = faults[at]
            go(3, "D", 1)
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                for other in ("user", "assistant"):
                    go(2 + extra, "R", 1, other, text)
                if role[:1] in ("s", "u", "a"):
                    go(extra, "K", 1, role, text)
    raise AssertionError


def brute_report(rows):
    groups = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in brute_damage(rows):
        groups[conv].append((turn, role, text))
    out = []
    for conv, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], identity(r[1], r[2])))
        seen, faults = set(), []
        for _, role, text in mine:
            words = WORD.findall(text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append((role, text, fault))
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[:1] for r, _, _ in faults]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, made = brute_repair(faults)
        kinds = [f for _, _, f in faults]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=str)


def table(spark, rows):
    extra = [(*r, 1, "x", 2, "K") for r in rows]
    return spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, copy int, signature string, head int, audit string")


def query(frame):
    return conversations.report(conversations.damaged(frame))


def odd_rows():
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(400)]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, "", "User"])
            text = rng.choice(["Yes.", "No!", "what?", "cut off", "", "  \n", None, "é漢.", "tail. \t", "a" * 3_000 + "."])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 5]), role, text))
    rows += [(1_000, t, r, f"{t} ok.") for t, r in enumerate(["system"] + ["user", "assistant"] * 40)]
    return rows + rows[:20]


def test_query_matches_a_search_over_all_edits(spark):
    rows = odd_rows()
    want = brute_report(rows)
    for parts in ("2", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = query(table(spark, rows))
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_given_conversations_match(spark):
    frame = read(spark, "/root/testdata/sf0.001", "conversations")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in query(frame).collect()), key=str) == brute_report(rows)


@pytest.mark.parametrize("seed", range(4))
def test_nodes_give_the_cheapest_audit(seed):
    rng = random.Random(seed)
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for _ in range(250):
        signature = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(0, 9)))
        nodes = [conversations.last_node()]
        for symbol in reversed(signature):
            nodes.append(conversations.node_before(symbol, nodes[-1]))
        faults = [
            ("user", "", "blank") if c == "x" else (names[c.lower()], "t", "truncated" if c.isupper() else None) for c in signature]
        cost, audit, _ = brute_repair(faults)
        assert (nodes[-1][0][0], conversations.audit_of(signature, nodes)) == (cost, audit), signature


def test_repaired_rows_hash_to_the_report(spark):
    damaged = conversations.damaged(table(spark, odd_rows()))
    made = {}
    for r in conversations.repaired(damaged).collect():
        made.setdefault(r["conv_id"], []).append((r["place"], f"{r['role']}:{r['text']}"))
    for r in conversations.report(damaged).collect():
        lines = [line for _, line in sorted(made.get(r["conv_id"], []))]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == r["repaired_sha256"]


def test_a_hot_conversation_is_streamed(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"line {t % 900}.") for t in range(30_000)] + [(c, 0, "user", "Hi.") for c in range(100, 160)]
    got = {r["conv_id"]: r for r in query(table(spark, rows)).collect()}
    assert got[7]["duplicate"] > 26_000 and len(got) == 61
    assert got[7]["cost"] >= 3 * (got[7]["duplicate"] + got[7]["blank"])
    assert query(table(spark, rows).limit(0)).count() == 0


def test_a_conversation_without_rows_is_kept(spark):
    conv = next(c for c in range(1_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = [tuple(r) for r in query(table(spark, [(conv, 0, "user", "Hi.")])).collect()]
    assert got == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
