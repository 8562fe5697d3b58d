"""Operator 11: spelling variants by a dictionary of trie-node pairs.

The prefixes of all words are the nodes of a trie, their suffixes those of the
trie of the reversed words; both are numbered. A word split at a position is a
pair (prefix node, suffix node), and so is a word with one code point skipped:

* two words of one length that differ only at a position have the same pair
  across that position skipped;
* a word with one code point more has, across it skipped, the same pair as the
  shorter word split there.

All words of one pair are neighbours, so a join on the two integers finds them
exactly. A pair holds at most one split word (the two nodes spell it) and one
skipping word for every code point of the alphabet: no group grows with the
data. In a run of equal code points only the first stands for the inserted
one, so every neighbour is counted once.

Nodes are numbered without a table of prefixes. Words are sorted over range
partitions; a word owns as many numbers as it has code points, and takes the
numbers of its predecessor as deep as both agree. Where a partition's first
word agrees with the words before it, its numbers are mapped to theirs
(``aliases``: at most one word's nodes for each partition).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SLIP = 199            # one occurrence in so many loses a code point
HELD_WORDS = 200_000  # counts a worker holds before it hands them on
HELD_CHARS = 32 << 20
SPLIT, FIRST, REPEATED = 0, 1, 2


def slipped_words(key: str, text: str, slip: int = SLIP) -> Counter:
    """Runs of letters of one text, A-Z lower-cased, counted after the slips:
    with h = crc32 of ``key:run``, the run loses its code point h % length if
    ``slip`` divides h."""
    start = zlib.crc32(f"{key}:".encode())
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
        h = zlib.crc32(run.encode(), start)
        if h % slip == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP,
                min_length: int = 6, min_count: int = 5) -> DataFrame:
    """``(word, n)``: the distinct words of whole texts with at least
    ``min_length`` code points and ``min_count`` occurrences. A null text has
    no words; a null id is the empty text in the slips. Workers count before
    anything is shuffled."""
    src = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("key"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def run(batches):
        held: Counter = Counter()
        chars = 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for key, text in zip(b.column("key"), b.column("text")):
                for word, n in slipped_words(key.as_py(), text.as_py(), slip).items():
                    if len(word) >= min_length:
                        if word not in held:
                            chars += len(word)
                        held[word] += n
                if len(held) > HELD_WORDS or chars > HELD_CHARS:
                    yield rows()
                    held.clear()
                    chars = 0
        yield rows()

    counts = map_batches(src, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= min_count)


def numbered(words: DataFrame, key: str, nodes: str, parts: int) -> tuple[DataFrame, dict[int, int]]:
    """The words with ``nodes``, their trie nodes by depth (0, the root, is
    number 0), ``id`` (a number that grows in the order of ``key``) and
    ``part``; and the aliases of nodes at the partitions' ends."""
    spark = words.sparkSession
    cols = words.columns

    def run(batches):
        part = TaskContext.get().partitionId()
        at, last, path = (part << 40) + 1, "", [0]
        for b in batches:
            keys, lists, ids = b.column(key).to_pylist(), [], []
            for w in keys:
                same = len(commonprefix((last, w)))
                path = path[:same + 1] + list(range(at + same, at + len(w)))
                lists.append(path)
                ids.append(at)
                at += len(w)
                last = w
            yield pa.RecordBatch.from_arrays([b.column(c) for c in cols] + [pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int64())),
                                             pa.array([part] * len(ids), pa.int32())], names=[*cols, f"{nodes}_id", nodes, "part"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    ordered = words.repartitionByRange(parts, key).sortWithinPartitions(key)
    out = written(map_batches(ordered, run, f"{schema}, {nodes}_id long, {nodes} array<long>, part int"), nodes)
    ends = out.groupBy("part").agg(F.min(F.struct(key, nodes)).alias("lo"), F.max(F.struct(key, nodes)).alias("hi"))
    aliases: dict[int, int] = {}
    last, path = "", [0]
    for r in sorted(ends.collect(), key=lambda r: r["part"]):  # two words for each partition
        for d in range(1, len(commonprefix((last, r["lo"][key]))) + 1):
            aliases[r["lo"][nodes][d]] = path[d]
        last, path = r["hi"][key], [aliases.get(x, x) for x in r["hi"][nodes]]
    return out.drop("part"), aliases


def _lookup(aliases: dict[int, int]):
    keys = np.array(sorted(aliases), np.int64)
    to = np.array([aliases[k] for k in keys.tolist()], np.int64)

    def apply(x: np.ndarray) -> np.ndarray:
        if not len(keys):
            return x
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[at] == x, to[at], x)
    return apply


def node_pairs(words: DataFrame, forward: dict[int, int], backward: dict[int, int]) -> DataFrame:
    """``(p, s, kind, id, n)``: the pairs of every word, split at each
    position (``SPLIT``) and with each position skipped (``FIRST`` of a run of
    equal code points, or ``REPEATED``)."""
    def run(batches):
        to_p, to_s = _lookup(forward), _lookup(backward)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                length = np.array([len(w) for w in part.column("word").to_pylist()], np.int64)
                if not len(length):
                    continue
                points = np.frombuffer("".join(part.column("word").to_pylist()).encode("utf-32-le"), np.uint32)
                p, s = to_p(part.column("fwd").flatten().to_numpy()), to_s(part.column("bwd").flatten().to_numpy())
                base = np.cumsum(length + 1) - (length + 1)           # where a word's nodes begin
                row = np.repeat(np.arange(len(length)), length + 1)
                pos = np.arange(len(row)) - base[row]                 # 0 .. length
                back = base[row] + length[row] - pos                  # node of the suffix from pos on
                inner = pos < length[row]
                first = np.ones(len(points), bool)
                first[1:] = points[1:] != points[:-1]
                first[np.cumsum(length)[:-1]] = True                  # a word's first code point
                kind = np.concatenate([np.full(len(row), SPLIT, np.int8), np.where(first, FIRST, REPEATED).astype(np.int8)])
                rows = np.concatenate([row, row[inner]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([p, p[inner]])), pa.array(np.concatenate([s[back], s[back[inner] - 1]])), pa.array(kind),
                     pa.array(part.column("fwd_id").to_numpy()[rows]), pa.array(part.column("n").to_numpy()[rows])],
                    names=["p", "s", "kind", "id", "n"])

    return map_batches(words, run, "p long, s long, kind byte, id long, n long", rows=4096)


def _neighbours(p, s, kind, ids, n):
    """(id, near words, id and count of the largest) of every word in each of
    the whole groups of equal (p, s), which are adjacent."""
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    kind, ids, n, group = kind[many], ids[many], n[many], group[many]
    order = np.lexsort((ids, -n, group))  # the largest first, ties to the smaller word
    kind, ids, n, group = kind[order], ids[order], n[order], group[order]
    size = int(group[-1]) + 1 if len(group) else 0

    def best_but(own: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many of ``among`` other than itself are in a row's group, the
        place of the first, -1 if none) for the rows ``own``."""
        places = np.flatnonzero(among)
        count = np.bincount(group[places], minlength=size)
        start = np.cumsum(count) - count
        g = group[own]
        lead = np.append(places, -1)[np.minimum(start[g], len(places))]
        itself = (lead == own) & (count[g] > 0)
        others = count[g] - among[own]
        nxt = np.append(places, -1)[np.minimum(start[g] + itself, len(places))]
        return others, np.where(others > 0, nxt, -1)

    out = []
    skips, firsts, all_ = kind != SPLIT, kind == FIRST, np.ones(len(kind), bool)
    for sort, among in ((FIRST, all_), (REPEATED, skips), (SPLIT, firsts)):
        own = np.flatnonzero(kind == sort)
        others, best = best_but(own, among)
        own, others, best = own[others > 0], others[others > 0], best[others > 0]
        out.append((ids[own], others, ids[best], n[best]))
    return [np.concatenate(c) for c in zip(*out)]


def near_words(pairs: DataFrame) -> DataFrame:
    """``(id, n_near, near_n, near_id)`` of every word with a neighbour: how
    many, and the largest one's count and id. Pairs are brought together by a
    keyed shuffle and read in order, a group at a time."""
    together = pairs.repartition("p", "s").sortWithinPartitions("p", "s")

    def run(batches):
        rest = None
        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("p", "s", "kind", "id", "n")]
            if rest is not None:
                cols = [np.concatenate(c) for c in zip(rest, cols)]
            if not len(cols[0]):
                continue
            p, s = cols[0], cols[1]
            cut = int(np.flatnonzero((p != p[-1]) | (s != s[-1]))[-1]) + 1 if (p[0], s[0]) != (p[-1], s[-1]) else 0
            rest = [c[cut:] for c in cols]  # the last group may go on: at most the alphabet and one
            if cut:
                yield _batch(_neighbours(*[c[:cut] for c in cols]))
        if rest is not None and len(rest[0]):
            yield _batch(_neighbours(*rest))

    found = map_batches(together, run, "id long, n_near long, near_id long, near_n long", rows=1 << 16)
    best = F.max(F.struct("near_n", (-F.col("near_id")).alias("low")))
    return (found.groupBy("id").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("id", "n_near", F.col("best.near_n").alias("near_n"), (-F.col("best.low")).alias("near_id")))


def _batch(cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["id", "n_near", "near_id", "near_n"])


def roots(forms: DataFrame) -> DataFrame:
    """``(id, root)``: the end of the chain that starts at every link ``(id,
    form)``. Each round doubles the steps taken; a chain's counts grow by a
    factor from word to word, so it is a few words long."""
    at = written(forms.selectExpr("id", "form as root"), "roots")
    while True:
        ahead = at.selectExpr("id as root", "root as further")
        at = written(at.join(ahead, "root", "left").selectExpr("id", "coalesce(further, root) as root", "further is not null as moved"), "roots")
        if at.filter("moved").isEmpty():
            return at.select("id", "root")
        at = at.select("id", "root")


def group_variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """Spelling variants among distinct ``(word, n)``: ``word``, ``form``,
    ``root``, ``n``, ``n_near``, ``form_n``.

    Two words are near if one inserted, deleted or replaced code point makes
    one of the other; ``n_near`` counts a word's near words. Its form is the
    near word of largest n (ties: the smallest in code-point order) if that is
    at least ``factor`` times its own n, else null, and so is ``form_n``. Its
    root ends the chain of forms (itself without a form). An empty table gives
    an empty one; words and counts are not null.
    """
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fwd, forward = numbered(words.select("word", "n"), "word", "fwd", parts)
    both, backward = numbered(fwd.withColumn("back", F.reverse("word")), "back", "bwd", parts)
    near = near_words(node_pairs(both.select("word", "n", "fwd_id", "fwd", "bwd"), forward, backward))
    # ids grow with the words' code-point order, so the smaller id is the smaller word
    table = fwd.select(F.col("fwd_id").alias("id"), "word", "n")
    all_ = written(table.join(near, "id", "left").withColumn("form", F.expr(f"case when near_n >= {int(factor)} * n then near_id end")), "near")
    linked = all_.filter("form is not null")
    ends = roots(linked.select("id", "form"))
    named = table.select("id", "word")
    variants = (linked.join(ends, "id").join(named.selectExpr("id as form", "word as form_word"), "form")
                .join(named.selectExpr("id as root", "word as root_word"), "root")
                .selectExpr("word", "form_word as form", "root_word as root", "n", "n_near", "near_n as form_n"))
    rest = all_.filter("form is null").selectExpr("word", "cast(null as string) as form", "word as root", "n",
                                                  "coalesce(n_near, 0) as n_near", "cast(null as bigint) as form_n")
    return variants.unionAll(rest)


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``group_variants`` of the slipped words of whole texts (see
    ``word_counts``). Other columns are not read."""
    return group_variants(written(word_counts(docs, id_col, text_col), "words"))
