"""Operator 12: near-duplicate groups by SimHash and pigeonhole blocks.

A text's fingerprint has a bit set if more than half of its shingle hashes
have it. To find all fingerprints at most ``distance`` bits apart, the 64 bits
are cut into ``distance + 3`` blocks: two close fingerprints differ in at most
``distance`` of them, so they agree on some choice of three. For every choice
there is one table of keys (the three blocks' bits), and fingerprints are
joined on equal keys; every pair found is verified.

A bucket of more than ``CROWD`` different fingerprints is not compared pair by
pair: its members agree on the key's bits, so the free bits are cut and joined
in the same way once more, and again. After three levels at most
``2 ** free`` fingerprints (32 for a distance of 2) can be in one bucket, so
no bucket grows with the data and no pair is lost.

Documents of one fingerprint are one class (its smallest id), found by a
pre-aggregated shuffle, so copies never meet each other.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import id_text, map_batches, written
from .minhash import components

SEED = 42
KEPT = 3       # blocks that a key holds
CROWD = 64     # a bucket of more fingerprints is cut again
LEVELS = 3
BLOCK_SHINGLES = 1 << 15


def shingle_hashes(text: str, size: int):
    """XXH64 of the text's word shingles in order, in blocks of bounded size;
    repeats included. Fewer words than ``size``: the whole sequence is one
    shingle; none: nothing."""
    words = text.encode().lower().split()  # bytes: A-Z only, white space is [\x20\x09-\x0D]
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    ends = ends[size - 1:] if len(words) >= size else ends[-1:]
    for at in range(0, n, BLOCK_SHINGLES):
        cut = map(slice, starts[at:min(n, at + BLOCK_SHINGLES)].tolist(), ends[at:at + BLOCK_SHINGLES].tolist())
        yield np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cut), repeat(SEED)), np.uint64)


def fingerprint(text: str, size: int) -> tuple[int, int]:
    """(fingerprint as an unsigned number, number of shingles)."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, size):
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]), n


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint's 64 bits), ``n_shingles``; one
    pass over the texts, which are read, not moved."""
    fields = [StructField("doc_id", LongType()), StructField("fp", LongType()), StructField("n_shingles", LongType())]

    def run(batches):
        for b in batches:
            got = [fingerprint(t.as_py(), size) for t in b.column("text")]
            fp = np.array([f for f, _ in got], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp), pa.array([n for _, n in got], pa.int64())],
                                             names=[f.name for f in fields])

    return map_batches(docs, run, StructType(fields))


def key_masks(free: int, distance: int) -> list[int]:
    """Masks of the keys that cut the ``free`` bits (a mask) into ``distance +
    KEPT`` blocks and hold ``KEPT`` of them; the bits outside ``free`` are
    held by all."""
    bits = [i for i in range(64) if free >> i & 1]
    n = distance + KEPT
    blocks = [sum(1 << i for i in bits[k * len(bits) // n:(k + 1) * len(bits) // n]) for k in range(n)]
    return [~free & (1 << 64) - 1 | sum(c) for c in combinations(blocks, KEPT)]


def mask_levels(distance: int) -> list[list[tuple[int, int, int]]]:
    """For every level its tables as (table, table of the level above, mask)."""
    out, above = [], [(0, 0, 0)]
    for _ in range(LEVELS):
        above = [(i, up, m) for i, (up, m) in enumerate((up, m) for up, _, held in above
                                                        for m in key_masks(~held & (1 << 64) - 1, distance))]
        out.append(above)
    return out


def close_pairs(classes: DataFrame, distance: int) -> DataFrame:
    """Of different fingerprints ``(rep, fp)`` all pairs ``(a, b)`` of reps at
    most ``distance`` bits apart, each once."""
    spark = classes.sparkSession
    found, members = None, classes.withColumn("up", F.lit(0))
    for level, masks in enumerate(mask_levels(distance)):
        rows = [(t, up, m - (1 << 64) if m >> 63 else m) for t, up, m in masks]
        # a fixed number of rows: 10, 100, 1000 for a distance of 2
        tables = F.broadcast(spark.createDataFrame(rows, "t int, up int, mask long"))
        entry = members.join(tables, "up").select("rep", "fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        shared = entry.groupBy("t", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        buckets = written(entry.join(shared, ["t", "key"]), "blocks")
        last = level == LEVELS - 1
        few = buckets if last else buckets.filter(F.col("members") <= CROWD)
        other = few.selectExpr("t", "key", "rep as rep2", "fp as fp2")
        pairs = (few.join(other, ["t", "key"]).filter(f"fp < fp2 and bit_count(fp ^ fp2) <= {int(distance)}")
                 .select(F.greatest("rep", "rep2").alias("a"), F.least("rep", "rep2").alias("b")))
        found = pairs if found is None else found.unionAll(pairs)
        members = buckets.filter(F.col("members") > CROWD).select("rep", "fp", F.col("t").alias("up"))
        if last or members.isEmpty():
            break
    return found.distinct()


def simhash_groups(docs: DataFrame, size: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups of whole texts: ``doc_id``, ``fingerprint`` (16
    hexadecimal digits), ``component_id`` (the smallest id that links reach)
    and ``n_shingles``.

    Texts are linked if their fingerprints differ in at most ``distance``
    bits. A text of fewer than ``size`` words is one shingle; a null, empty or
    blank text has none and the fingerprint zero, which links like any other.
    One row for each row of the input: rows that share an id are one document,
    all of whose fingerprints are linked under that id. Rows without an id are
    linked with nothing and have a null group. Other columns are not read.
    """
    prints = written(fingerprints(id_text(docs, id_col, text_col, "long"), size), "fingerprints")
    with_id = prints.filter("doc_id is not null")
    classes = written(with_id.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    # an id with several fingerprints links their classes
    several = with_id.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo < hi").select("doc_id")
    own = (with_id.join(several, "doc_id", "left_semi").join(classes, "fp").filter("rep <> doc_id")
           .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())
    # nodes are ids: a class stands under its smallest one. Two classes may share that id
    # (an id with several fingerprints), which links them already
    groups = components(close_pairs(classes.select("rep", "fp"), distance).filter("a <> b").unionAll(own))
    g = groups.selectExpr("node as rep", "component")
    named = written(classes.join(g, "rep", "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id")), "named")
    # classes of over a thousandth of all rows, fewer than a thousand whatever the input, go to
    # their rows by broadcast; no other key of the shuffle join holds more
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(named.filter(F.col("n") * 1000 > total).select("fp", "component_id"))
    cold = named.filter(F.col("n") * 1000 <= total).select("fp", "component_id")
    out = (with_id.join(hot, "fp").unionByName(with_id.join(hot.select("fp"), "fp", "left_anti").join(cold, "fp"))
           .select("doc_id", "fp", "component_id", "n_shingles"))
    rest = prints.filter("doc_id is null").select("doc_id", "fp", F.col("doc_id").alias("component_id"), "n_shingles")
    return out.unionAll(rest).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_shingles")
