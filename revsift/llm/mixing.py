"""Operator 7: mixing sources to target weights by Pareto order sampling.

Each source has a target number of words. A document is first given the
whole copies that are certain: floor(target / size of its source). What the
target still lacks is filled by one more copy of some documents, chosen by
Pareto order sampling: a document with inclusion probability p and a uniform
number u, fixed by its id, has the rank

    (u / (1 - u)) / (p / (1 - p))

(random odds over inclusion odds) and the documents of smallest rank are
taken until the words they hold come nearest to what is lacking. p grows
with the square root of the document's size, scaled so that the expected
words equal the lack; a p beyond 1 counts as almost certain.

The running sum of words in rank order is taken over rank bins first (one
row for each source and bin) and over single rows only inside the one bin of
each source where the sum passes its goal, so a source that holds a third of
all rows is never sorted in one task. What comes out is the last row taken
of each source; every row is then settled where it is. Everything is built
from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hex_int
from .common import written

# Weights dealt to the sources in turn, by code point order of their names.
WEIGHTS = (5.0, 2.0, 1.0)
# No source is repeated more often than this.
MAX_COPIES = 3
# Rows that one rank bin holds at most on average; bins of a source beyond LEAST_BINS grow with the rows.
BIN_ROWS = 10_000
LEAST_BINS = 1024

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES,
                   total: float | None = None) -> DataFrame:
    """``(source, source_size)`` -> also ``target``. The sources, by code
    point (null last), weigh ``weights`` in turn and share ``total`` (all
    words by default). A target stops at ``max_copies`` times its source's
    size; the excess goes to the others by weight until none is above: the
    targets are min(cap, level * weight) for the one level that uses up the
    total, found in the order of cap / weight. One row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    s = (sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
         .withColumn("total", F.sum("source_size").over(everything).cast("double") if total is None else F.lit(float(total)))
         .withColumn("all_w", F.sum("w").over(everything)))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    # the level if the sources before this one are at their caps
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    open_level = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), "level"))
                       ).over(everything)["level"]
    return s.withColumn("target", F.coalesce(F.least("cap", open_level * F.col("w")), F.col("cap"))) \
            .select("source", "source_size", "target")


def _placed(rows: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """``rows`` (with ``doc_id``, ``source``, ``size``) with their source's
    plan and their rank, as r / (1 + r): the same order, between 0 and 1."""
    u = (hex_int(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12).cast("double")
         + F.lit(0.5)) / F.lit(float(1 << 48))
    p = F.least(F.lit(1 - 1e-9), F.col("scale") * F.sqrt(F.col("size").cast("double")))
    plan = plan.withColumnRenamed("source", "plan_source")
    # a few numbers for each source: small enough to be broadcast unless there are very many sources
    r = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")), "left").drop("plan_source")
    return (r.withColumn("u", u).withColumn("p", p)
            .withColumn("rank", F.col("u") * (1 - F.col("p")) / (F.col("u") * (1 - F.col("p")) + (1 - F.col("u")) * F.col("p")))
            .withColumn("bin", F.least(F.col("bins") - 1, F.floor(F.col("rank") * F.col("bins"))))
            .withColumn("eligible", (F.col("size") > 0) & (F.col("lack") > 0)))


def source_plan(rows: DataFrame, weights: tuple[float, ...], max_copies: float, total: float | None, seed: str) -> DataFrame:
    """One row for each source of ``rows`` (``doc_id``, ``source``, ``size``):
    its target, whole copies, what is lacking, and up to which rank another
    copy is taken (bin and, inside it, rank, id and size of the last row)."""
    measure = F.sqrt(F.col("size").cast("double"))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"),
                                      F.sum(F.col("size") * measure).alias("mass"))
    plan = source_targets(sums.select("source", "source_size"), weights, max_copies, total)
    sums = sums.select(F.col("source").alias("s0"), "n", "mass")
    plan = plan.join(sums, plan["source"].eqNullSafe(F.col("s0")), "left").drop("s0")
    plan = (plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12))
                            .otherwise(0).cast("long"))
            .withColumn("lack", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
            .withColumn("scale", F.when(F.col("mass") > 0, F.col("lack") / F.col("mass")).otherwise(0.0))
            .withColumn("bins", F.greatest(F.lit(LEAST_BINS), F.ceil(F.col("n") / BIN_ROWS)).cast("long")))
    plan = written(plan.drop("n", "mass"), "sources")
    r = _placed(rows, plan, seed).filter("eligible")
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edge = (r.groupBy("source", "bin", "lack").agg(F.sum("size").alias("words"))
            .withColumn("below", F.coalesce(F.sum("words").over(upto), F.lit(0)))
            .filter((F.col("below") < F.col("lack")) & (F.col("below") + F.col("words") >= F.col("lack")))
            .select(F.col("source").alias("s1"), F.col("bin").alias("edge_bin"), "below"))
    edge = written(edge, "edges")
    # the rows of one bin of each source, in order; equal rows go together
    inside = (r.join(edge, F.col("source").eqNullSafe(F.col("s1")) & (F.col("bin") == F.col("edge_bin")))
              .groupBy("s1", "below", "lack", "rank", "doc_id", "size").agg(F.sum("size").alias("words")))
    running = Window.partitionBy("s1").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    after = F.col("below") + F.sum("words").over(running)
    last = (inside.withColumn("after", after).withColumn("before", F.col("after") - F.col("words"))
            # taken if the sum with it is as near to the goal as the sum without it
            .filter((F.col("before") < F.col("lack")) & (F.col("after") - F.col("lack") <= F.col("lack") - F.col("before")))
            .groupBy("s1").agg(F.max(F.struct("rank", "doc_id", "size")).alias("last")))
    plan = plan.join(edge.select("s1", "edge_bin"), F.col("source").eqNullSafe(F.col("s1")), "left").drop("s1")
    plan = plan.join(last, F.col("source").eqNullSafe(F.col("s1")), "left").drop("s1")
    return written(plan, "plan")


def _copies() -> Column:
    inside = (F.col("bin") == F.col("edge_bin")) & F.col("last").isNotNull() & (F.struct("rank", "doc_id", "size") <= F.col("last"))
    more = F.col("eligible") & (F.col("edge_bin").isNull() | (F.col("bin") < F.col("edge_bin")) | inside)
    return F.col("whole") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    # one narrow copy: ids, sources and sizes, so the texts are read once
    return written(docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size")), "sizes")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES,
                total: float | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """For every row: ``doc_id``, ``source``, ``size`` (words), ``source_size``,
    ``target`` (its source's), ``copies`` and ``taken`` (copies * size).

    The words taken of a source come nearest to its target that whole
    documents in rank order allow; no document is taken more than
    ``max_copies`` times. Null sources are one source; a null text has size 0
    and is never taken; ties in rank are settled by id, then size, and rows
    equal in all three are taken together; a null id ranks as the empty text.
    The same rows give the same result. An empty table gives no rows. Other
    columns are not read, and the texts are read once.
    """
    rows = _sizes(docs, id_col, text_col, source_col)
    out = _placed(rows, source_plan(rows, weights, max_copies, total, seed), seed)
    return out.select("doc_id", "source", "size", "source_size", "target", _copies().cast("long").alias("copies")) \
              .withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES,
                    total: float | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, as often
    as ``mix_sources`` takes it (not at all for 0 copies, so rows of size 0
    are left out). Each row is settled where it is, by its source's plan; the
    texts are not shuffled."""
    plan = source_plan(_sizes(docs, id_col, text_col, source_col), weights, max_copies, total, seed)
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs[id_col].alias("doc_id"), docs[source_col].alias("source"),
                       word_count(docs[text_col]).alias("size"))
    out = _placed(rows, plan, seed).withColumn("copies", _copies().cast("int")).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
