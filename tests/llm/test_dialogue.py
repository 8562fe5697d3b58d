"""Operator 13 against brute force."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from revsift.llm import dialogue
from revsift.llm.dialogue import cheapest, conversation_repairs, damaged, folded, repair_conversations, ways
from revsift.llm.queries import op13_conversation_repair

from .conftest import MEDIUM

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
WORDY = re.compile(r"[^\x20\x09-\x0D]")


def plain_edits(rows):
    """(cost, audit, repaired) of rows (initial, forced, cut): every way,
    from the end, by cost and audit."""
    def add(q):
        return {"": "u", "s": "u", "u": "a", "a": "u"}[q]

    @lru_cache(None)
    def best(i, q, room):
        out = []
        if i == len(rows) and q in ("", "a"):
            out.append((0, ""))
        steps = []
        if room:
            steps.append((2, "I", i, add(q), room - 1))
        if i < len(rows):
            initial, forced, cut = rows[i]
            steps.append((3, "D", i + 1, q, 2))
            if not forced:
                steps.append((2 + cut, "R", i + 1, add(q), 2))
                if (q, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    steps.append((cut, "K", i + 1, initial, 2))
        for cost, letter, j, to, left in steps:
            rest = best(j, to, left)
            if rest is not None:
                out.append((cost + rest[0], letter + rest[1]))
        return min(out, default=None)
    return best(0, "", 2)


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation, undamaged key given."""
    seen, kinds, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        solid = WORDY.findall(text)
        kind = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
        if kind:
            count[kind] += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = plain_edits(tuple((r[1][:1], k in ("blank", "duplicate"), int(k == "truncated")) for r, k in zip(rows, kinds)))
    out, at, state = [], 0, ""
    for letter in audit:
        if letter in "IR":
            state = "a" if state == "u" else "u"
            out.append(("user" if state == "u" else "assistant") + ":" + (rows[at][2] if letter == "R" else ""))
        elif letter == "K":
            state = rows[at][1][0]
            out.append(f"{rows[at][1]}:{rows[at][2]}")
        at += letter != "I"
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_damage(table):
    convs = {}
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        convs.setdefault(conv, []).extend([] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1))
    def place(r):
        return (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return {c: sorted(rows, key=place) for c, rows in convs.items()}


def check(got, table):
    want = {c: plain_repair(rows) for c, rows in plain_damage(table).items()}
    got = [(r["conv_id"], tuple(r[c] for c in COLUMNS)) for r in got]
    assert len(got) == len(want)
    for c, values in got:
        assert values == want[c], c
    return want


def test_query_matches_brute_force(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = check(op13_conversation_repair(spark, MEDIUM).collect(), table)
    letters = "".join(w[6] for w in want.values())
    assert set(letters) == set("DIKR")


def random_rows(rnd, conv, n):
    return [(conv, rnd.choice([None, *range(n)]) if rnd.random() < 0.1 else i, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]),
             rnd.choice(["Yes.", "No", "why?", " ", "", None, "é!", f"text {i}.", f"text {i}"])) for i in range(n)]


def test_random_conversations_and_edges(spark):
    rnd = random.Random(4)
    table = [row for conv in [None, *range(120)] for row in random_rows(rnd, conv, rnd.randrange(1, 12))]
    table += [(500, None, None, None), (501, 3, "user", "a."), (501, 3, "user", "a."), (501, 3, "assistant", "a."), (501, None, "user", "a.")]
    gone = next(i for i in range(600, 900) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table.append((gone, 0, "user", "Gone."))
    rnd.shuffle(table)
    df = spark.createDataFrame(table, SCHEMA).withColumn("copies", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("audit", F.lit(None).cast("int"))
    want = check(conversation_repairs(df).collect(), table)
    assert want[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversation_repairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 7])
def test_blocks_give_the_same_repairs(spark, monkeypatch, block):
    """Conversations over many blocks and partitions, one of them most rows."""
    sys.setrecursionlimit(20_000)  # for the plain version
    rnd = random.Random(block)
    table = random_rows(rnd, 1, 400) + [row for conv in range(2, 12) for row in random_rows(rnd, conv, 9)]
    monkeypatch.setattr(dialogue, "BLOCK", block)
    got = conversation_repairs(spark.createDataFrame(table, SCHEMA).repartition(5)).collect()
    check(got, table)


def test_search_equals_plain_and_folds():
    rnd = random.Random(9)
    for n in list(range(9)) * 25:
        codes = bytes(rnd.choice([0, 1, 1, 2, 2, 3]) + rnd.choice([0, 0, 0, 4, 8, 16]) for _ in range(n))
        rows = tuple(("sua?"[c & 3], bool(c & 24), int(bool(c & 4))) for c in codes)
        want = plain_edits(rows)
        assert cheapest(codes, 0, dialogue.ENDS) == want
        cuts = sorted(rnd.choices(range(n + 1), k=rnd.randrange(3)))
        pieces = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
        assert folded([ways(p) for p in pieces]) == want
    long = bytes(rnd.choice([1, 2, 1, 2, 5, 6, 9]) for _ in range(20_000))
    cost, audit = cheapest(long, 0, dialogue.ENDS)
    assert sum(x != "I" for x in audit) == len(long) and cost > 0


def test_repaired_rows_follow_the_pattern(spark):
    rnd = random.Random(12)
    table = [row for conv in range(40) for row in random_rows(rnd, conv, 8)]
    found, repaired = repair_conversations(damaged(spark.createDataFrame(table, SCHEMA)))
    roles = {}
    for r in sorted(repaired.collect(), key=lambda r: (r["conv_id"], r["at"])):
        roles.setdefault(r["conv_id"], []).append(r)
    audits = {r["conv_id"]: r["audit"] for r in found.collect()}
    for c, rows in roles.items():
        assert re.fullmatch("s?(ua)+", "".join(r["role"][0] for r in rows)) and [r["at"] for r in rows] == list(range(len(rows)))
        assert "".join(r["edit"] for r in rows) == audits[c].replace("D", "")
    assert all(set(audits[c]) <= {"D"} for c in audits.keys() - roles.keys())
