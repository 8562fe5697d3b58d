"""Operator 3: sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table and
the shards take turns: on its turn a shard claims the next slot of its
permutation that is still free. A key's slot is its hash modulo the table's
size, so a broadcast of the table places any number of keys in constant time
each, and taking one shard away moves few keys of the others.

The table depends on the parameters only (never on data); it is filled on
the driver and enters the plan as a literal. Everything on the rows is built
from SQL functions.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hex_int

TABLE_SIZE = 65_537  # prime


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], size: int = TABLE_SIZE, weights: list[float] | None = None) -> list[int]:
    """Slot -> index of its shard. With ``weights`` a shard skips turns in
    proportion (the heaviest shard takes all of its turns). ``size`` must be
    a prime of at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if size < len(shards) or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("size must be a prime of at least the number of shards")
    if weights is not None and (len(weights) != len(shards) or min(weights) <= 0):
        raise ValueError("weights must be positive, one for each shard")
    top = max(weights) if weights else 1.0
    share = [w / top for w in weights] if weights else [1.0] * len(shards)
    place = [_hash(f"offset:{s}") % size for s in shards]
    step = [_hash(f"skip:{s}") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    credit = [0.0] * len(shards)
    owner = [-1] * size
    left = size
    while left:
        for i in range(len(shards)):
            credit[i] += share[i]
            if credit[i] < 1 - 1e-9:
                continue
            credit[i] -= 1
            while owner[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % size
            owner[place[i]] = i
            left -= 1
            if not left:
                break
    return owner


def table_frame(spark: SparkSession, owner: list[int], name: str) -> DataFrame:
    """``(slot, <name>)``: the table as a frame of len(owner) rows."""
    text = ",".join(map(str, owner))
    return (spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", name))
            .select("slot", F.col(name).cast("int").alias(name)))


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key: 60 bits of the md5 of its text modulo the table's size;
    a null key counts as the empty text."""
    return F.pmod(hex_int(F.coalesce(key.cast("string"), F.lit("")), 1, 15), F.lit(size)).cast("int")


def place_documents(docs: DataFrame, shards: list[str], key_col: str = "doc_id", size: int = TABLE_SIZE,
                    weights: list[float] | None = None, drained: str | None = None) -> DataFrame:
    """``doc_id`` (the key), ``slot``, ``shard`` (index in ``shards``) of every
    row, and ``next_shard``: where the row goes once the shard ``drained`` is
    taken away (null without one).

    A null key has the slot of the empty text; repeated rows go to the same
    shard; an empty table gives no rows; other columns are not read. One scan
    and one broadcast of ``size`` rows, no shuffle, whatever the keys' skew.
    """
    spark = docs.sparkSession
    lookup = table_frame(spark, fill_table(shards, size, weights), "shard")
    if drained is not None:
        keep = [i for i, s in enumerate(shards) if s != drained]
        if len(keep) == len(shards):
            raise ValueError("drained must be one of the shards")
        smaller = fill_table([shards[i] for i in keep], size, [weights[i] for i in keep] if weights else None)
        lookup = lookup.join(F.broadcast(table_frame(spark, [keep[i] for i in smaller], "next_shard")), "slot")
    else:
        lookup = lookup.withColumn("next_shard", F.lit(None).cast("int"))
    rows = docs.select(docs[key_col].alias("doc_id"), slot_of(docs[key_col], size).alias("slot"))
    return rows.join(F.broadcast(lookup), "slot").select("doc_id", "slot", "shard", "next_shard")
