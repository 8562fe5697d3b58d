"""Operator 8: near-duplicate groups by SuperMinHash.

Every distinct shingle of a document gets a pseudo-random permutation of the
signature's slots and competes for them in that order: in turn j it offers
j + r (r uniform) to the slot its permutation names. Slots are filled with
smaller offers first, so a document is done in the first turn after which no
slot is empty - one or two turns for most documents, at most as many as there
are slots. The offers of one element are correlated, which makes the signature
less noisy than independent hashes.

Documents with the same shingle set are one class (its smallest id), found by
a pre-aggregated shuffle of set hashes, so thousands of copies are one row
afterwards. Bands of the signatures give candidate classes. In every
bucket the members are first compared with one centre. Links found are
grouped, and of the pairs of a bucket that are in different groups by then
only those are compared that can still be similar, given what each has in
common with the centre (``linked_groups``), so a group of thousands is not
compared pair by pair. Every link is confirmed on the full shingle sets. A
link between two members of one group cannot change any group, so no group
is missed for leaving it out.

Groups are connected components: every partition joins its links by
union-find, then the remaining links are contracted by shuffles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import id_text, map_batches, written
from .words import GOLD, mix64, word_hashes

SLOTS = 128
BANDS = 32  # of 4 slots: a pair of similarity 0.8 shares no band once in 2 * 10^7
TURN_ELEMENTS = 1 << 18

_SALTS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of the texts one after the other,
    offsets). A text of fewer words has its whole sequence as one shingle; a
    text without words has none."""
    words, off = word_hashes(texts)
    n = np.diff(off)
    out_n = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), out_n)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(out_n) - out_n, out_n) + off[:-1][owner]
    with np.errstate(over="ignore"):
        h = np.zeros(len(owner), np.uint64)
        for k in range(size):
            inside = start + k < off[1:][owner]
            w = np.where(inside, words[np.minimum(start + k, max(len(words) - 1, 0))], np.uint64(k)) if len(words) else h
            h = mix64(h * GOLD + w + np.uint64(k + 1))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[first], owner[first]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]) if len(n) else np.zeros(1, np.int64)


def super_minhash(h: np.ndarray, off: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures, one row of ``slots`` numbers for each set. Sets are done in
    blocks of bounded size (a larger single set is done alone, its first turns
    filling all slots before permutations need room)."""
    n = np.diff(off)
    sig = np.full((len(n), slots), np.inf)
    block = 0
    while block < len(n):
        end = block + 1
        while end < len(n) and off[end + 1] - off[block] <= TURN_ELEMENTS:
            end += 1
        _minhash_block(h[off[block]:off[end]], np.repeat(np.arange(end - block), n[block:end]), sig[block:end], slots)
        block = end
    return sig


def _minhash_block(h: np.ndarray, owner: np.ndarray, sig: np.ndarray, slots: int) -> None:
    """One block of sets in turns, all elements of open sets at a time. Until
    turn 2 the exchanges made so far are two numbers an element; only then
    (few elements are left) permutations are laid out."""
    past: list[np.ndarray] = []  # places exchanged with places 0, 1
    perm = None
    flat = sig.reshape(-1)
    for j in range(slots):
        if not len(h):
            return
        with np.errstate(over="ignore"):
            x = mix64(h + np.uint64(j + 1) * GOLD)
            r = (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
            k = j + (mix64(x) % np.uint64(slots - j)).astype(np.int64)
        if j == 0:
            slot = k
            past.append(k)
        elif j == 1:
            slot = np.where(k == past[0], 0, k)
            past.append(k)
        else:
            at = np.arange(len(h))
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.uint16), (len(h), 1))
                for i, to in enumerate(past):
                    moved = perm[at, to]
                    perm[at, to] = perm[:, i]
                    perm[:, i] = moved
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(flat, owner * slots + slot, r + j)
        go = np.isinf(sig).any(axis=1)[owner]
        if not go.all():
            h, owner = h[go], owner[go]
            past = [p[go] for p in past] if perm is None else past
            perm = perm[go] if perm is not None else None


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of every signature."""
    rows = sig.shape[1] // bands
    bits = np.ascontiguousarray(sig[:, :rows * bands]).view(np.uint64).reshape(len(sig), bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    with np.errstate(over="ignore"):
        for i in range(rows):
            key = mix64(key * GOLD + bits[:, :, i])
    return key.view(np.int64)


def document_bands(docs: DataFrame, size: int, slots: int, bands: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``set1``, ``set2`` (128-bit hash of the
    distinct shingle set; null for the empty set) and ``keys`` (its band
    keys). One pass over the texts, which are read, not moved."""
    fields = [StructField("doc_id", LongType()), StructField("n_shingles", LongType()), StructField("set1", LongType()),
              StructField("set2", LongType()), StructField("keys", ArrayType(LongType()))]

    def run(batches):
        for b in batches:
            h, off = shingle_sets(b.column("text"), size)
            n = np.diff(off)
            with np.errstate(over="ignore"):
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(h ^ salt), dtype=np.uint64)]) for salt in _SALTS]
                sets = [pa.array((s[off[1:]] - s[off[:-1]]).view(np.int64), mask=n == 0) for s in sums]
            keys = band_keys(super_minhash(h, off, slots), bands).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), *sets, lists], names=[f.name for f in fields])

    return map_batches(docs, run, StructType(fields))


def confirm_links(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of candidate pairs ``(a, b)`` those with 100 * common shingles >=
    percent * shingles of either, on the full sets of both texts."""
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches):
        for b in batches:
            ha, oa = shingle_sets(b.column("ta"), size)
            hb, ob = shingle_sets(b.column("tb"), size)
            ok = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = ha[oa[i]:oa[i + 1]], hb[ob[i]:ob[i + 1]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * common >= percent * (len(x) + len(y) - common)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return map_batches(both, run, "a long, b long")


def local_union_find(edges: DataFrame) -> DataFrame:
    """Links ``(a, b)`` -> (node, root) links of each partition's forest; a
    partition's nodes are at most those of its links."""
    def run(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(p, p)
            return x

        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        for i in range(0, len(nodes), 100_000):
            part = nodes[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())],
                                             names=["a", "b"])

    return map_batches(edges, run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of the links ``(a, b)``: the
    smallest node that can be reached. Partitions are contracted by
    union-find; then every node takes the smallest label among its own and
    those that its links name, and links are redrawn to the label, until
    none moves (about log2 of the longest chain rounds)."""
    links = written(local_union_find(edges).filter("a <> b").selectExpr("a as node", "b as label"), "links")
    seen = None
    while True:
        # large star: neighbours of a node above it point to the smallest one
        both = links.unionAll(links.selectExpr("label as node", "node as label"))
        low = both.groupBy("node").agg(F.min("label").alias("low"))
        low = low.select("node", F.least("node", "low").alias("low"))
        up = both.filter("label > node").join(low, "node").selectExpr("label as node", "low as label")
        # small star: a node and its neighbours below it point to the smallest one
        down = up.groupBy("node").agg(F.min("label").alias("low"))
        step = (up.join(down, "node").selectExpr("label as node", "low as label")
                .unionAll(down.selectExpr("node", "low as label")).filter("node <> label").distinct())
        links = written(step, "links")
        now = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(node, label))")).first()
        if now == seen:
            return links.selectExpr("node", "label as component")
        seen = now


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80, slots: int = SLOTS, bands: int = BANDS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups of whole texts: ``doc_id``, ``n_shingles``
    (distinct shingles of ``size`` words), ``component_id`` (the smallest id
    that links reach) and ``kept`` (whether that is its own).

    Texts are linked if 100 * common >= percent * either on their shingle
    sets. A text of fewer than ``size`` words is one shingle; a null, empty or
    blank text has none and is linked with nothing (it is its own group).
    Rows that share an id count as one document if their texts do; else each
    of their sets is linked under that id. Rows without an id are linked with
    nothing and have a null group. Other columns are not read.
    """
    src = id_text(docs, id_col, text_col, "long")
    sets = written(document_bands(src, size, slots, bands), "sets")
    # copies first: one row for each distinct set, pre-aggregated before the shuffle
    full = sets.filter("set1 is not null and doc_id is not null")
    reps = written(full.groupBy("set1", "set2").agg(F.min("doc_id").alias("rep")), "classes")
    tagged = written(full.drop("keys").join(reps, ["set1", "set2"]).select("doc_id", "n_shingles", "rep"), "tagged")
    entry = (full.join(reps.withColumnRenamed("rep", "doc_id"), ["set1", "set2", "doc_id"], "left_semi")
             .select("doc_id", "n_shingles", F.explode("keys").alias("key")))
    crowded = (entry.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("members"))
               .filter("lo < hi").select("key", "members"))
    # buckets with at least two classes; every comparison is about them only
    buckets = written(entry.join(crowded, "key").distinct(), "buckets")
    near = written(src.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi"), "near")
    # an id with several texts links their classes
    several = tagged.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi")
    links = tagged.join(several, "doc_id").filter("rep <> doc_id").selectExpr("rep as a", "doc_id as b").distinct()
    groups = linked_groups(buckets, near, links, size, percent)
    g = groups.selectExpr("node as rep", "component")
    out = tagged.join(g, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    rest = (sets.filter("set1 is null or doc_id is null")
            .select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.unionAll(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def linked_groups(buckets: DataFrame, texts: DataFrame, links: DataFrame, size: int, percent: int) -> DataFrame:
    """``(node, component)`` of the links among the members ``(key, doc_id,
    n_shingles, members)`` of the buckets, and of further ``links``.

    First every member is compared with the centre of its buckets: the one
    whose buckets hold most members, which is where the texts of a group were
    copied from, if that is there. Then two members of one bucket in different
    groups remain. With i shingles of a, and j of b, in the centre's set, they
    can only be similar if they share a shingle that the centre lacks, or if
    least(i, j) alone is enough; only such pairs are compared."""
    weight = buckets.groupBy("doc_id").agg(F.sum("members").alias("w"))
    centre = (buckets.join(weight, "doc_id").groupBy("key")
              .agg(F.max(F.struct("w", (-F.col("doc_id")).alias("low"))).alias("m")).select("key", (-F.col("m.low")).alias("c")))
    pairs = written(buckets.join(centre, "key").filter("doc_id <> c").select("doc_id", "c").distinct(), "pairs")
    spokes = written(compare_with_centres(pairs, texts, size, percent), "spokes")
    links = links.unionAll(spokes.filter("linked").select(F.greatest("doc_id", "c").alias("a"), F.least("doc_id", "c").alias("b")))
    groups = components(links)
    own = spokes.join(groups.selectExpr("node as doc_id", "component as g"), "doc_id", "left") \
                .join(groups.selectExpr("node as c", "component as cg"), "c", "left") \
                .withColumn("g", F.coalesce("g", "doc_id")).withColumn("cg", F.coalesce("cg", "c"))
    own = written(own, "members")
    fits = f"100 * least(n, n2) >= {percent} * greatest(n, n2)"
    # the centre's shingles alone are enough: one of the two is not in the centre's group
    full = own.filter(f"100 * i >= {percent} * n")
    second = full.selectExpr("c", "doc_id as d2", "n as n2", "i as i2", "g as g2")
    alone = (full.filter("g <> cg").join(second, "c")
             .filter(f"g <> g2 and {fits} and {percent} * (n + n2) <= {100 + percent} * least(i, i2)"))
    # they share a shingle that the centre lacks: of a member's m others it shares at least
    # k, so one of all but its k - 1 last ones in any fixed order. Those of one group only
    # come first (they are in no such pair), then the rare ones.
    mixed = own.groupBy("c").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo < hi").select("c")
    each = own.join(mixed, "c").select("c", "doc_id", "n", "g", (F.size("rest") - F.col("k") + 1).alias("first"),
                                       F.size("rest").alias("m"), F.explode("rest").alias("h"))
    shared = each.groupBy("c", "h").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count(F.lit(1)).alias("f")) \
                 .filter("lo < hi").select("c", "h", "f")
    of_member = Window.partitionBy("c", "doc_id")
    each = (each.join(shared, ["c", "h"]).withColumn("s", F.count(F.lit(1)).over(of_member))
            .withColumn("at", F.row_number().over(of_member.orderBy("f", "h")))
            .filter("m - s + at <= first").select("c", "h", "doc_id", "n", "g"))
    each = written(each, "rest")
    other = each.selectExpr("c", "h", "doc_id as d2", "n as n2", "g as g2")
    more = each.join(other, ["c", "h"]).filter(f"g < g2 and {fits}")
    last = alone.select("doc_id", "d2").unionAll(more.select("doc_id", "d2")) \
                .select(F.greatest("doc_id", "d2").alias("a"), F.least("doc_id", "d2").alias("b")).distinct()
    found = written(confirm_links(written(last, "pairs"), texts, size, percent), "found")
    return components(groups.selectExpr("node as a", "component as b").unionAll(found))


def compare_with_centres(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs ``(doc_id, c)`` with ``n`` (shingles of the document), ``i``
    (those in the centre's set too), ``linked``, ``rest`` (its other shingles)
    and ``k``: a similar text has at least percent of n in common with it, so
    it shares that - i of the others, 1 at least if the centre's are not
    enough."""
    both = pairs.join(texts.select("doc_id", "text"), "doc_id") \
                .join(texts.select(F.col("doc_id").alias("c"), F.col("text").alias("ct")), "c").select("doc_id", "c", "text", "ct")

    def run(batches):
        for b in batches:
            h, off = shingle_sets(b.column("text"), size)
            hc, oc = shingle_sets(b.column("ct"), size)
            n, i, linked, rest, must = np.diff(off), [], [], [], []
            for k in range(b.num_rows):
                x, y = h[off[k]:off[k + 1]], hc[oc[k]:oc[k + 1]]
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                own = x[y[at] != x]
                common = len(x) - len(own)
                i.append(common)
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
                must.append(max(1, -(-percent * len(x) // 100) - common))
                rest.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("c"), pa.array(n), pa.array(i, pa.int64()), pa.array(linked, pa.bool_()),
                 pa.array(rest, pa.list_(pa.int64())), pa.array(must, pa.int64())], names=["doc_id", "c", "n", "i", "linked", "rest", "k"])

    return map_batches(both, run, "doc_id long, c long, n long, i long, linked boolean, rest array<long>, k long")
