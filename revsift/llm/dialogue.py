"""Operator 13: repair of conversations by the cheapest edits.

A conversation should have the role initials ``(s?(ua)+)?``. Its rows and the
four states of that pattern span a lattice: an edge keeps, reroles or deletes
the next row, or inserts an empty turn. The cheapest way through is found by a
bidirectional Dijkstra search: heaps from both ends settle nodes until their
tops exceed the best crossing, so that all crossings of equal cost are done;
of the cheapest ways through them, the one of least audit is then walked. A
state and a letter name one edge, so an audit stands for one way.

Rows are reduced to a code and sorted over range partitions by conversation
and turn; a long conversation is a run of blocks, whatever the number of its
partitions. A block's cheapest ways between all states are found apart from
the others, and joined block by block afterwards: two ways of equal cost and
ends are never one the beginning of the other (it would have more insertions),
so the least audit of a whole is put together from the least of its parts.

Only a conversation's audit (one letter for each row) and its repaired texts,
streamed in order, meet in one task; the digest of the texts is a chain over
all of them.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, map_batches, written

# --- fixed values: the costs and the pattern (s?(ua)+)? -----------------------
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
ENDS = (START, AFTER_ASSISTANT)
ADDED = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)   # the turn to add in a state leads there
LEGAL_NEXT = {"s": "u", "u": "a", "a": "u"}
# ------------------------------------------------------------------------------

# A row's code: its initial (place in "sua", 3: another), and what is wrong with it.
INITIALS = "sua"
TRUNCATED, BLANK, DUPLICATE = 4, 8, 16
BLOCK = 4096        # rows of a block
KNOWN = 100_000     # short sequences whose repair a worker keeps


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn``, modulo 20: 0 drops the row
    (``copies`` 0), 1 empties its text, 2 removes ``[.!?]``, 3 repeats it
    (``copies`` 2), 4 makes its role user. Nulls of roles and texts, and in
    the key, are one space."""
    def key(c: str) -> Column:
        return F.coalesce(rows[c].cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(key("conv_id"), F.lit(":"), key("turn"))) % 20
    role, text = key("role"), key("text")
    return rows.select(
        rows["conv_id"].alias("conv_id"), rows["turn"].alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def coded(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``digest`` (of role and text), ``code``,
    ``copies``, ``late`` (the same role and text stands at an earlier turn):
    one row for all equal rows of a turn. Texts stay where they are."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1))
    place = F.when(F.col("role") == "", 0).otherwise(F.expr(f"instr('{INITIALS}', left(role, 1))"))
    wrong = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    code = F.when(place == 0, len(INITIALS)).otherwise(place - 1) + wrong
    narrow = rows.select("conv_id", "turn", row_digest(), code.cast("int").alias("code"), "copies")
    narrow = written(narrow.groupBy("conv_id", "turn", "digest", "code").agg(F.sum("copies").alias("copies")), "turns")
    seen = (narrow.filter("copies > 0").groupBy("conv_id", "digest")
            .agg(F.min(turn_order()).alias("first"), F.count(F.lit(1)).alias("turns")).filter("turns > 1")
            .select(F.col("conv_id").alias("conv"), F.col("digest").alias("same"), "first"))
    met = narrow.join(seen, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("digest") == F.col("same")), "left")
    return met.select("conv_id", "turn", "digest", "code", "copies", F.coalesce(turn_order() > F.col("first"), F.lit(False)).alias("late"))


def row_digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest")


def turn_order() -> Column:
    return F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))


_BLOCK_FIELDS = ("part int, seq int, alone boolean, codes binary, blank long, duplicate long, truncated long, illegal long, "
                 "lo long, hi long, turns long, first_turn long, last_turn long")


def blocks(codes: DataFrame, parts: int) -> DataFrame:
    """The conversations' rows in order, cut where a block is full or a
    partition ends; ``alone`` if the block is its whole conversation for
    certain. Nulls first; equal turns by digest. A conversation without rows
    has one empty block."""
    key = codes.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "digest"]
    ordered = codes.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches):
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        size = 0
        conv, seq, block, begun, opened = None, 0, None, False, True

        def close(ended: bool):
            # ``opened``: the partition's first conversation may have begun before it
            nonlocal size
            codes, blank, dup, cut, illegal, lo, hi, turns, first, last = block
            out.append((conv, part, seq, ended and seq == 0 and not opened, bytes(codes), blank, dup, cut, illegal, lo, hi, turns, first, last))
            size += len(codes) + 100

        for b in batches:
            for c, turn, code, copies, late in zip(*(b.column(x).to_pylist() for x in ("conv_id", "turn", "code", "copies", "late"))):
                if not begun or c != conv:
                    if begun:
                        close(True)
                        opened = False
                    conv, seq, begun = c, 0, True
                    block = [bytearray(), 0, 0, 0, 0, None, None, 0, None, None]
                for i in range(copies):
                    if len(block[0]) == BLOCK:
                        close(False)
                        seq += 1
                        block = [bytearray(), 0, 0, 0, 0, None, None, 0, None, None]
                    one = code
                    if code & BLANK:
                        block[1] += 1
                    elif late or i:
                        one = code & 3 | DUPLICATE
                        block[2] += 1
                    elif code & TRUNCATED:
                        block[3] += 1
                    if block[0]:
                        block[4] += not legal_next(block[0][-1], one)
                    if turn is not None and turn != block[9]:
                        block[7] += 1
                        block[9] = block[6] = turn
                        if block[8] is None:
                            block[8] = block[5] = turn
                    block[0].append(one)
                if size > BATCH_BYTES:
                    yield _columns(out, key)
                    out, size = [], 0
        if begun:
            close(False)
        if out:
            yield _columns(out, key)

    return map_batches(ordered, run, f"conv_id {key}, {_BLOCK_FIELDS}", rows=10_000)


def _columns(rows: list[tuple], key: str) -> pa.RecordBatch:
    types = [pa.string() if key == "string" else pa.int32() if key == "int" else pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(),
             *[pa.int64()] * 9]
    names = ["conv_id", *[f.split()[0] for f in _BLOCK_FIELDS.split(", ")]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def legal_next(a: int, b: int) -> bool:
    a, b = a & 3, b & 3
    return a < 3 and b < 3 and LEGAL_NEXT[INITIALS[a]] == INITIALS[b]


def _after_keep(state: int, code: int) -> int | None:
    """The state behind a row kept in ``state``."""
    initial = code & 3
    if initial == 0:
        return AFTER_SYSTEM if state == START else None
    if initial == 3:
        return None
    to = AFTER_USER if initial == 1 else AFTER_ASSISTANT
    return to if ADDED[state] == to else None


def _edits(code: int | None) -> list[list[tuple[str, int, int, int]]]:
    """For each state its edges as (letter, cost, rows taken, next state) by
    letter; ``code`` None: no row is left."""
    out = []
    for q in range(4):
        edges = [("I", INSERT, 0, ADDED[q])]
        if code is not None:
            edges.append(("D", DELETE, 1, q))
            if not code & (BLANK | DUPLICATE):
                cut = CUT if code & TRUNCATED else 0
                edges.append(("R", REROLE + cut, 1, ADDED[q]))
                if (to := _after_keep(q, code)) is not None:
                    edges.append(("K", cut, 1, to))
        out.append(sorted(edges))
    return out


_EDGES = {c: _edits(c) for c in (None, *range(32))}
_BACK = {c: [[(cost, taken, p) for p in range(4) for _, cost, taken, to in edges[p] if to == q] for q in range(4)]
         for c, edges in _EDGES.items()}
_INSERTED = _BACK[None]
_TAKEN = {c: [[e for e in back[q] if e[1]] for q in range(4)] for c, back in _BACK.items()}


def cheapest(codes: bytes, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, least audit) of the cheapest way over all rows from the state
    ``start`` to one of ``ends``; None if there is none. Nodes are 4 * rows
    taken + state."""
    n = len(codes)
    ahead, behind = {start: 0}, {4 * n + q: 0 for q in ends}
    heap_a, heap_b = [(0, start)], [(0, x) for x in behind]
    done_a, done_b = set(), set()
    best = 1 << 60
    while heap_a and heap_b and heap_a[0][0] + heap_b[0][0] <= best:
        if heap_a[0][0] <= heap_b[0][0]:
            d, x = heappop(heap_a)
            if x in done_a:
                continue
            done_a.add(x)
            i, q = x >> 2, x & 3
            steps = [(cost, 4 * (i + taken) + to) for _, cost, taken, to in _EDGES[codes[i] if i < n else None][q]]
            here, there, heap = ahead, behind, heap_a
        else:
            d, x = heappop(heap_b)
            if x in done_b:
                continue
            done_b.add(x)
            i, q = x >> 2, x & 3
            steps = [(cost, 4 * i + p) for cost, _, p in _INSERTED[q]]
            if i:
                steps += [(cost, 4 * (i - 1) + p) for cost, _, p in _TAKEN[codes[i - 1]][q]]
            here, there, heap = behind, ahead, heap_b
        if x in there:
            best = min(best, d + there[x])
        for cost, y in steps:
            if d + cost < here.get(y, 1 << 60):
                here[y] = d + cost
                heappush(heap, (d + cost, y))
                if y in there:
                    best = min(best, d + cost + there[y])
    if best == 1 << 60:
        return None
    # forward nodes that lead to a cheapest crossing
    open_ = [x for x, d in ahead.items() if d + behind.get(x, 1 << 60) == best]
    leads = set(open_)
    while open_:
        x = open_.pop()
        i, q = x >> 2, x & 3
        steps = [(cost, 4 * i + p) for cost, _, p in _INSERTED[q]]
        if i:
            steps += [(cost, 4 * (i - 1) + p) for cost, _, p in _TAKEN[codes[i - 1]][q]]
        for cost, y in steps:
            if y not in leads and ahead.get(y, 1 << 60) + cost == ahead[x]:
                leads.add(y)
                open_.append(y)
    # the least letter that stays on a cheapest way, from the start
    x, d, audit, goals = start, 0, [], {4 * n + q for q in ends}
    while d < best or x not in goals:
        i = x >> 2
        for letter, cost, taken, to in _EDGES[codes[i] if i < n else None][x & 3]:
            y, e = 4 * (i + taken) + to, d + cost
            if (y in leads and ahead[y] == e) or e + behind.get(y, 1 << 60) == best:
                audit.append(letter)
                x, d = y, e
                break
    return best, "".join(audit)


def ways(codes: bytes) -> list[list[tuple[int, str] | None]]:
    """The cheapest way of a block between any two states."""
    return [[cheapest(codes, p, (q,)) for q in range(4)] for p in range(4)]


def joined(a: list, b: list) -> list:
    """The cheapest ways over two blocks, one after the other."""
    def over(p: int, r: int):
        return min(((a[p][q][0] + b[q][r][0], a[p][q][1] + b[q][r][1]) for q in range(4) if a[p][q] and b[q][r]), default=None)
    return [[over(p, r) for r in range(4)] for p in range(4)]


def folded(parts: list[list]) -> tuple[int, str]:
    """Cost and audit of a conversation from the ways of its blocks, joined in
    pairs so that an audit is copied a logarithmic number of times."""
    while len(parts) > 1:
        parts = [joined(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return min(w for q in ENDS if (w := parts[0][START][q]) is not None)


def _solved(found: DataFrame) -> DataFrame:
    """Blocks with ``ways``: one (from, to, cost, audit) for a block alone,
    else all between any two states."""
    names = [c for c in found.columns if c != "codes"]
    way = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def run(batches):
        known: dict[bytes, tuple[int, str]] = {}
        for b in batches:
            out, ends = [], []
            for alone, codes in zip(b.column("alone").to_pylist(), b.column("codes").to_pylist()):
                if alone:
                    got = known.get(codes)
                    if got is None:
                        got = cheapest(codes, START, ENDS)
                        if len(codes) <= 64 and len(known) < KNOWN:
                            known[codes] = got
                    out.append([{"p": START, "q": START, "cost": got[0], "audit": got[1]}])
                else:
                    out.append([{"p": p, "q": q, "cost": w[0], "audit": w[1]} for p, row in enumerate(ways(codes)) for q, w in enumerate(row) if w])
                ends.append((codes[0] & 3, codes[-1] & 3) if codes else (None, None))
            cols = [b.column(c) for c in names] + [pa.array([e[k] for e in ends], pa.int32()) for k in (0, 1)] + [pa.array(out, way)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "first_code", "last_code", "ways"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name != "codes")
    return map_batches(found, run, f"{schema}, first_code int, last_code int, ways array<struct<p:int,q:int,cost:bigint,audit:string>>", rows=256)


def reports(rows: DataFrame, parts: int) -> DataFrame:
    """One row for each conversation of ``rows`` (``conv_id``, ``turn``,
    ``role``, ``text``, ``copies``): ``conv_id``, ``gaps``, ``blank``,
    ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``,
    ``n_rows``."""
    solved = written(_solved(written(blocks(coded(rows), parts), "blocks")), "ways")
    gaps = "coalesce(hi - lo + 1 - turns, 0) as gaps"
    alone = solved.filter("alone").selectExpr("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "ways[0].cost as cost",
                                              "ways[0].audit as audit")
    key = rows.schema["conv_id"].dataType.simpleString()
    fields = [c for c in solved.columns if c not in ("conv_id", "alone")]
    runs = (solved.filter("not alone").groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("runs")))  # by part and seq: a block each

    def fold(batches):
        for b in batches:
            out = []
            for runs in b.column("runs"):
                runs = runs.as_py()
                total = {k: sum(r[k] for r in runs) for k in ("blank", "duplicate", "truncated", "illegal")}
                full = [r for r in runs if r["first_code"] is not None]
                total["illegal"] += sum(not legal_next(x["last_code"], y["first_code"]) for x, y in zip(full, full[1:]))
                timed = [r for r in full if r["lo"] is not None]
                # a turn that goes on in the next block is one turn
                turns = sum(r["turns"] for r in timed) - sum(x["last_turn"] == y["first_turn"] for x, y in zip(timed, timed[1:]))
                total["gaps"] = timed[-1]["hi"] - timed[0]["lo"] + 1 - turns if timed else 0
                parts = []
                for r in runs:
                    parts.append([[None] * 4 for _ in range(4)])
                    for w in r["ways"]:
                        parts[-1][w["p"]][w["q"]] = (w["cost"], w["audit"])
                total["cost"], total["audit"] = folded(parts)
                out.append(total)
            names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *[pa.array([t[c] for t in out], pa.int64()) for c in names],
                                             pa.array([t["audit"] for t in out], pa.string())], names=["conv_id", *names, "audit"])

    long = map_batches(runs, fold, f"conv_id {key}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string", rows=16)
    return alone.unionAll(long)


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The conversations after their audits: ``conv_id``, ``at`` (place from
    0), ``role``, ``text``, ``edit`` (K, R or I), in order within a
    partition, a conversation whole in one. Rows are streamed, so a worker
    holds one batch and one audit."""
    key = rows.schema["conv_id"].dataType.simpleString()
    head = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
                        F.lit(None).cast("binary").alias("digest"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("copies"))
    body = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", row_digest(), "role", "text", F.col("copies").cast("int"))
    order = ["conv_id", "kind", "turn", "digest"]
    ordered = head.unionAll(body).repartition("conv_id").sortWithinPartitions(*order)
    types = {"string": pa.string(), "int": pa.int32()}

    def run(batches):
        conv, audit, spot, state, at = None, "", 0, START, 0
        out: list[tuple] = []
        size = 0

        def put(role: str, text: str, letter: str):
            nonlocal at, size
            out.append((conv, at, role, text, letter))
            at += 1
            size += len(text) + 64

        def added(letter: str, text: str):
            nonlocal state
            state = ADDED[state]
            put("user" if state == AFTER_USER else "assistant", text, letter)

        def insert():
            nonlocal spot
            while spot < len(audit) and audit[spot] == "I":
                added("I", "")
                spot += 1

        def batch():
            cols = list(zip(*out)) if out else [()] * 5
            kinds = [types.get(key, pa.int64()), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["conv_id", "at", "role", "text", "edit"])

        for b in batches:
            for c, kind, role, text, copies in zip(*(b.column(x).to_pylist() for x in ("conv_id", "kind", "role", "text", "copies"))):
                if kind == 0:
                    insert()  # behind the last row of the conversation before
                    conv, audit, spot, state, at = c, text, 0, START, 0
                    continue
                for _ in range(copies):
                    insert()
                    letter = audit[spot]
                    spot += 1
                    if letter == "R":
                        added("R", text)
                    elif letter == "K":
                        state = _after_keep(state, max(INITIALS.find(role[0]), 0))
                        put(role, text, "K")
                if size > BATCH_BYTES:
                    yield batch()
                    out, size = [], 0
        insert()
        yield batch()

    return map_batches(ordered, run, f"conv_id {key}, at long, role string, text string, edit string")


def digests(repaired: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of the repaired rows, ``role:text``
    joined by newlines, read as they come."""
    key = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches):
        conv, sha = None, None
        done: list[tuple] = []
        for b in batches:
            for c, at, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "at", "role", "text"))):
                if at == 0:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha = c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if done:
                yield _pairs(done, key)
                done = []
        if sha is not None:
            yield _pairs([(conv, sha.hexdigest())], key)

    return map_batches(repaired, run, f"conv_id {key}, repaired_sha256 string")


def _pairs(rows: list[tuple], key: str) -> pa.RecordBatch:
    ids = pa.array([c for c, _ in rows], {"string": pa.string(), "int": pa.int32()}.get(key, pa.int64()))
    return pa.RecordBatch.from_arrays([ids, pa.array([d for _, d in rows], pa.string())], names=["conv_id", "repaired_sha256"])


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired rows) of conversations ``(conv_id, turn, role, text,
    copies)``; ids are strings, ints or longs.

    The report has one row for each id (null is one of them), also for those
    without rows (``copies`` 0): zeros and an empty audit. Rows stand by turn,
    nulls first; rows of one turn by a digest of role and text, equal rows
    beside each other. A row is blank without a character outside
    ``[\\x20\\x09-\\x0D]``, else a duplicate if its role and text stood
    before, else truncated if the last such character is none of ``.!?``.
    ``gaps`` counts the turns missing between the first and the last; null
    turns are not looked at. A role counts by its first character; one that
    is not s, u or a (or empty) fits nowhere. Other columns are not read.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(reports(rows, parts), "reports")
    return found, repaired_rows(rows, found)


def conversation_repairs(conversations: DataFrame) -> DataFrame:
    """Damage and repair of all conversations, with a digest of each repaired
    one (of nothing, if no row is left)."""
    found, repaired = repair_conversations(damaged(conversations))
    sums = digests(repaired).withColumnRenamed("conv_id", "conv")
    empty = hashlib.sha256().hexdigest()
    return (found.join(sums, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
            .withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(empty))).drop("conv"))
