"""Retrieval and answer evaluation.

Definitions (ours, from the IR literature; see README):
  E = distinct relevant ids of a query; R = retrieved list cut at k.
  hit_rate = [R and E intersect]; mrr = 1/rank of the first hit;
  precision = |R&E|/|R| (0 if R empty); recall = |R&E|/|E|;
  ap = sum over hits of (hits so far / rank) / |E|;
  ndcg = sum over hits of 1/log2(rank+1) / the same over ranks 1..min(|E|,k)
  (Jarvelin & Kekalainen 2002, binary gain).
Queries with an empty E keep a row with NULL metrics and drop out of means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distributed import broadcast_if_small, cut_lineage, spread, top_k_per_group

METRICS = ("hit_rate", "mrr", "precision", "recall", "ap", "ndcg")
DIGITS = 6


def _r(c: Column) -> Column:
    return F.round(c, DIGITS)


def ideal_dcg(n: Column) -> Column:
    """sum_{i=1..n} 1/log2(i+1) (0 for n <= 0)."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0).cast("double"),
                       lambda acc, i: acc + F.when(i <= n, F.lit(1.0) / F.log2(i + F.lit(1))).otherwise(F.lit(0.0)))


# E1 -----------------------------------------------------------------------------
_GAP = "[ \\t\\r\\n]+"


def passage_qrels(queries: DataFrame, docs: DataFrame, q_col: str = "item_id", q_text: str = "text",
                  doc_id_col: str = "doc_id", doc_text: str = "text", max_broadcast_rows: int = 100_000) -> DataFrame:
    """(q, doc) pairs, each once, where a text of the document contains a
    passage of the query as a substring (same case). Ids keep their types.

    All words of a passage but its first and last stand in a text that
    contains it as whole words. One pass over the texts writes which documents
    have which of these words; the rarest one is the passage's anchor, and a
    passage with a word that no document has is in none. ``instr`` decides in
    a second pass, where the texts stand: the pairs of documents and anchors,
    and the passages, travel to them by broadcast.
    Beyond ``max_broadcast_rows`` rows of these, they meet by shuffle joins, in
    which only documents with an anchor take part. Passages without inner
    words are compared with every document, in blocks of at most
    ``max_broadcast_rows`` passages. Null ids, and null and empty texts, have
    no pairs."""
    q = queries.select(F.col(q_col).alias("q"), F.col(q_text).alias("_p")).filter(F.col("q").isNotNull() & (F.length("_p") > 0))
    words = F.split("_p", _GAP)
    q = cut_lineage(q.distinct().withColumn("_inner", F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))))
    d = spread(docs.select(F.col(doc_id_col).alias("doc"), F.col(doc_text).alias("_t"))
               .filter(F.col("doc").isNotNull() & (F.length("_t") > 0)))
    named = q.filter(F.size("_inner") > 0).select("q", "_p", F.explode("_inner").alias("_w")).withColumn("_h", F.xxhash64("_w")).drop("_w")
    asked, _ = broadcast_if_small(named.select("_h").distinct(), max_broadcast_rows)
    # (document, word) by hash, the passages' words only: written once, counted and looked up
    held = d.select("doc", F.explode(F.array_distinct(F.split("_t", _GAP))).alias("_w")).select("doc", F.xxhash64("_w").alias("_h"))
    held = cut_lineage(held.join(asked, "_h", "left_semi"))
    counts = held.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    anchors = (named.join(counts, "_h", "left").groupBy("q", "_p")
               .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_h")).alias("a"))
               .filter("a.n > 0").select("q", "_p", F.col("a._h").alias("_h")))
    anchors, small = broadcast_if_small(cut_lineage(anchors), max_broadcast_rows)
    pairs, _ = broadcast_if_small(cut_lineage(held.join(anchors.select("_h", "q"), "_h").select("q", "doc").distinct()), max_broadcast_rows)
    texts = anchors.select("q", "_p")
    out = (d.join(pairs, "doc").join(F.broadcast(texts) if small else texts, "q")
            .filter(F.instr(F.col("_t"), F.col("_p")) > 0).select("q", "doc"))
    short = q.filter(F.size("_inner") == 0).select("q", "_p")
    n = short.count()
    blocks = -(-n // max_broadcast_rows)
    for i in range(blocks):
        part = short if blocks == 1 else short.filter(F.pmod(F.xxhash64("q", "_p"), F.lit(blocks)) == i)
        out = out.unionByName(d.join(F.broadcast(part), F.instr(F.col("_t"), F.col("_p")) > 0).select("q", "doc"))
    return out.distinct()


def make_pairs(nodes: DataFrame, questions: DataFrame, node_id: str = "node_id", node_text: str = "text",
               q_col: str = "q", question: str = "question", question_node: str = "node_id"):
    """A question set over nodes: ``(queries, corpus, relevant)`` as the
    three maps of the question-answer file - (q, question), (node_id, text)
    of the nodes that are asked about, (q, node_id). Questions without a
    known node or without text are left out."""
    asked = (questions.select(F.col(q_col).alias("q"), F.col(question).alias("question"), F.col(question_node).alias("node_id"))
             .filter(F.length("question") > 0))
    known = nodes.select(F.col(node_id).alias("node_id"), F.col(node_text).alias("text"))
    relevant = asked.join(known.select("node_id"), "node_id", "left_semi").select("q", "node_id").distinct()
    queries = asked.join(relevant.select("q").distinct(), "q", "left_semi").select("q", "question").distinct()
    corpus = known.join(relevant.select("node_id").distinct(), "node_id", "left_semi")
    return queries, corpus, relevant


# E2 / W6 / U4 ---------------------------------------------------------------------
def retrieval_metrics(queries: DataFrame, ranked: DataFrame, qrels: DataFrame, k: int,
                      q_col: str = "q", id_col: str = "doc") -> DataFrame:
    """Per query: hit_rate, mrr, precision, recall, ap, ndcg (rounded to 6).

    ``ranked`` is (q, rank, id) already cut at k; ``qrels`` is (q, id).
    Built from the query table with left joins, so queries with no hits or
    no relevant documents keep their row."""
    # an id that is listed twice counts at its best rank
    rk = ranked.select(F.col(q_col).alias("q"), F.col(id_col).alias("id"), "rank").filter(
        F.col("rank") <= k).groupBy("q", "id").agg(F.min("rank").alias("rank"))
    rel = qrels.select(F.col(q_col).alias("q"), F.col(id_col).alias("id")).distinct()
    # one pass over the ranked lists (at most k rows per query): a hit flag,
    # the running hit count in rank order, then every per-query sum at once
    flagged = rk.join(rel.withColumn("_hit", F.lit(1)), ["q", "id"], "left").fillna(0, ["_hit"])
    w = Window.partitionBy("q").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    flagged = flagged.withColumn("h", F.sum("_hit").over(w))
    is_hit = F.col("_hit") == 1
    per_q = flagged.groupBy("q").agg(
        F.count(F.lit(1)).alias("n_ret"), F.sum("_hit").alias("n_hits"),
        F.min(F.when(is_hit, F.col("rank"))).alias("first_rank"),
        F.sum(F.when(is_hit, F.col("h") / F.col("rank"))).alias("ap_num"),
        F.sum(F.when(is_hit, F.lit(1.0) / F.log2(F.col("rank") + 1))).alias("dcg"))
    n_rel = rel.groupBy("q").agg(F.count(F.lit(1)).alias("n_rel"))
    base = queries.select(F.col(q_col).alias("q")).distinct()
    t = (base.join(n_rel, "q", "left").join(per_q, "q", "left")
             .fillna(0, ["n_rel", "n_ret", "n_hits"]))
    has_e = F.col("n_rel") > 0
    nh = F.col("n_hits").cast("double")
    metrics = {
        "hit_rate": F.when(F.col("n_hits") > 0, 1.0).otherwise(0.0),
        "mrr": F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)),
        "precision": F.when(F.col("n_ret") > 0, nh / F.col("n_ret")).otherwise(0.0),
        "recall": nh / F.col("n_rel"),
        "ap": F.coalesce(F.col("ap_num"), F.lit(0.0)) / F.col("n_rel"),
        "ndcg": F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal_dcg(F.least(F.col("n_rel"), F.lit(k))),
    }
    return t.select(F.col("q").alias(q_col),
                    *[_r(F.when(has_e, v)).alias(name) for name, v in metrics.items()])


# E3 / A5 ---------------------------------------------------------------------------
def summarise_metrics(per_query: DataFrame, prefix: str, metrics=METRICS) -> DataFrame:
    """Long (name, value): mean of each metric over queries with relevant
    documents, plus the query counts. Names follow ``{prefix}_{metric}``."""
    aggs = [F.avg(m).alias(m) for m in metrics]
    aggs += [F.count(F.lit(1)).cast("double").alias("n_queries"),
             F.sum(F.when(F.col(metrics[0]).isNull(), 1).otherwise(0)).cast("double")
              .alias("n_queries_without_relevant")]
    wide = per_query.agg(*aggs)
    names = list(metrics) + ["n_queries", "n_queries_without_relevant"]
    stack = F.expr("stack({}, {})".format(
        len(names), ", ".join(f"'{prefix}_{n}', `{n}`" for n in names)))
    return wide.select(stack.alias("name", "value")).select("name", _r(F.col("value")).alias("value"))


# E4 --------------------------------------------------------------------------------
IR_CUTOFFS = (1, 3, 5, 10)


def ir_report(queries: DataFrame, ranked: DataFrame, hit_flag: DataFrame, n_relevant: DataFrame,
              cutoffs=IR_CUTOFFS, q_col: str = "q") -> DataFrame:
    """Cut-off metrics averaged over queries: (cutoff, metric, value).

    ``ranked`` (q, rank, id) at depth max(cutoffs); ``hit_flag`` marks which
    ranked rows are relevant (q, id, hit); ``n_relevant`` (q, n_rel). Relevant
    pairs are never materialised, so a label shared by a third of the corpus
    costs one count, not its square."""
    cut = F.array(*[F.lit(c) for c in cutoffs])
    rk = ranked.join(hit_flag, ["q", "id"]).filter(F.col("hit"))
    rk = rk.withColumn("h", F.row_number().over(Window.partitionBy("q").orderBy("rank")))
    per = (rk.select("q", "rank", "h", F.explode(cut).alias("cutoff"))
             .filter(F.col("rank") <= F.col("cutoff"))
             .groupBy("q", "cutoff")
             .agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first_rank"),
                  F.sum(F.lit(1.0) / F.log2(F.col("rank") + 1)).alias("dcg"),
                  F.sum(F.col("h") / F.col("rank")).alias("ap_num")))
    base = (queries.select(F.col(q_col).alias("q")).distinct()
                   .select("q", F.explode(cut).alias("cutoff"))
                   .join(n_relevant, "q", "left")
                   .filter(F.col("n_rel") > 0))
    t = base.join(per, ["q", "cutoff"], "left").fillna(0, ["hits"])
    c = F.col("cutoff")
    vals = {
        "accuracy": F.when(F.col("hits") > 0, 1.0).otherwise(0.0),
        "precision": F.col("hits") / c,
        "recall": F.col("hits") / F.col("n_rel"),
        "mrr": F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)),
        "ndcg": F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal_dcg(F.least(F.col("n_rel"), c)),
        "map": F.coalesce(F.col("ap_num"), F.lit(0.0)) / F.least(F.col("n_rel"), c),
    }
    per_q = t.select("cutoff", *[v.alias(n) for n, v in vals.items()])
    means = per_q.groupBy("cutoff").agg(*[F.avg(n).alias(n) for n in vals])
    stack = F.expr("stack({}, {})".format(len(vals), ", ".join(f"'{n}', `{n}`" for n in vals)))
    return means.select("cutoff", stack.alias("metric", "value")).select(
        "cutoff", "metric", _r(F.col("value")).alias("value"))


def label_relevance(ranked: DataFrame, items: DataFrame, id_col: str = "vec_id",
                    label_col: str = "label"):
    """Relevance by shared label, without building the pairs: hit flags for
    the ranked rows and |E| = (items with the label) - 1 per query."""
    lab = items.select(F.col(id_col).alias("id"), F.col(label_col).alias("lab"))
    qlab = lab.withColumnRenamed("id", "q").withColumnRenamed("lab", "qlab")
    hit = (ranked.select("q", "id").join(qlab, "q").join(lab, "id")
                 .select("q", "id", (F.col("lab") == F.col("qlab")).alias("hit")))
    sizes = lab.groupBy("lab").agg(F.count(F.lit(1)).alias("n"))
    n_rel = qlab.join(sizes, qlab.qlab == sizes.lab).select("q", (F.col("n") - 1).alias("n_rel"))
    return hit, n_rel


# E5 --------------------------------------------------------------------------------
def compare_reports(reports: dict) -> DataFrame:
    """Side-by-side: (metric, <one column per model>) with metric as
    ``{name}@{cutoff}``."""
    u = None
    for model, rep in reports.items():
        part = rep.select(F.concat(F.col("metric"), F.lit("@"), F.col("cutoff").cast("string")).alias("metric"),
                          F.lit(model).alias("model"), "value")
        u = part if u is None else u.unionByName(part)
    return u.groupBy("metric").pivot("model", list(reports)).agg(F.first("value"))


# E6 --------------------------------------------------------------------------------
def retrieval_errors(per_query: DataFrame, ranked: DataFrame, n_show: int = 10, q_col: str = "q", id_col: str = "doc",
                     nodes: DataFrame | None = None, qrels: DataFrame | None = None, node_id: str = "node_id",
                     node_text: str = "text") -> DataFrame:
    """Rows with hit_rate < 1, all metrics kept, ordered by the metrics in
    their usual order and then by query, with their first ``n_show`` retrieved
    ids (in rank order, comma-joined).

    With ``nodes`` and ``qrels`` also ``n_expected``, and the texts as lists:
    ``expected`` (relevant nodes by id) and ``retrieved_texts`` (by rank), at
    most ``n_show`` of each, cut before texts are joined; an id without a node
    is left out. Only rows with an error meet texts."""
    err = cut_lineage(per_query.filter(F.col("hit_rate") < 1))  # these rows are read several times
    shown = ranked.filter(F.col("rank") <= n_show).select(F.col("q").alias(q_col), F.col("rank").alias("_at"), F.col(id_col).alias("_id"))
    shown = cut_lineage(shown.join(err.select(q_col), q_col, "left_semi"))

    def in_order(df: DataFrame, what: str, name: str) -> DataFrame:
        got = F.array_sort(F.collect_list(F.struct("_at", F.col(what).alias("_v"))))
        return df.groupBy(q_col).agg(F.transform(got, lambda s: s["_v"]).alias(name))

    ids = in_order(shown.withColumn("_id", F.col("_id").cast("string")), "_id", "retrieved")
    out = err.join(ids.withColumn("retrieved", F.array_join("retrieved", ",")), q_col, "left")
    if nodes is not None:
        texts = nodes.select(F.col(node_id).alias("_id"), F.col(node_text).alias("_t"))
        rel = qrels.select(F.col("q").alias(q_col), F.col(id_col).alias("_id")).distinct().join(err.select(q_col), q_col, "left_semi")
        counts = rel.groupBy(q_col).agg(F.count(F.lit(1)).alias("n_expected"))
        first = top_k_per_group(rel, [q_col], [F.col("_id")], n_show, "_at")
        out = (out.join(counts, q_col, "left").fillna(0, ["n_expected"])
               .join(in_order(first.join(texts, "_id"), "_t", "expected"), q_col, "left")
               .join(in_order(shown.join(texts, "_id"), "_t", "retrieved_texts"), q_col, "left"))
    order = [m for m in METRICS if m in err.columns]
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in [*order, q_col]])


# A6 / E7 / U1 / J7 ----------------------------------------------------------------
def stack_scores(*frames: DataFrame) -> DataFrame:
    """Stack (example_id, metric, score) frames vertically."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def summarise_scores(long_scores: DataFrame) -> DataFrame:
    """Mean score per metric (NULL scores skipped)."""
    return long_scores.groupBy("metric").agg(_r(F.avg("score")).alias("mean"))


def score_table(long_scores: DataFrame, metrics: list, key: str = "example_id", predictions: DataFrame | None = None) -> DataFrame:
    """One row per example, one column per metric; with ``predictions``
    (key, query, answer, contexts) also these columns, joined by the key."""
    wide = long_scores.groupBy(key).pivot("metric", metrics).agg(F.first("score"))
    if predictions is None:
        return wide
    return wide.join(predictions.select(key, "query", "answer", "contexts"), key, "left").select(key, "query", "answer", *metrics, "contexts")


def joined_contexts(contexts) -> Column:
    """F16: contexts as one text, a blank line between two; null for none."""
    c = F.col(contexts) if isinstance(contexts, str) else contexts
    return F.when(F.size(c) > 0, F.array_join(c, "\n\n"))


def join_predictions(examples: DataFrame, predictions: DataFrame, key: str = "example_id") -> DataFrame:
    """Align examples and predictions by an explicit key (never by
    position)."""
    return examples.join(predictions, key)


# J5 --------------------------------------------------------------------------------
def fetch_nodes(id_lists: DataFrame, nodes: DataFrame, list_col: str = "ids", key: str = "q",
                node_id: str = "doc_id"):
    """Look up the nodes of each id list, order kept: (key, pos, node cols).
    Second result: ids that were not found (the reference raises on them)."""
    ex = id_lists.select(key, F.posexplode(list_col).alias("pos", "_nid"))
    found = ex.join(nodes, ex["_nid"] == nodes[node_id]).drop("_nid")
    missing = ex.join(nodes, ex["_nid"] == nodes[node_id], "left_anti")
    return found, missing


# J6 / E8 ---------------------------------------------------------------------------
def last_by_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) with the last row (by ``order``) winning; NULL values
    dropped first. Partial+final aggregation, no window."""
    return (df.filter(F.col(value).isNotNull() & F.col(key).isNotNull())
              .groupBy(key).agg(F.max_by(value, order).alias(value)))


def attach_expected(errors: DataFrame, examples: DataFrame, query_col: str = "query",
                    order: str = "example_id", contexts_col: str | None = None) -> DataFrame:
    """Attach the expected answer by query text (last duplicate wins,
    rows without an answer do not count); a missing query keeps its row with
    ``missing = true``. With ``contexts_col`` also that row's reference
    contexts as one text (``expected_contexts``)."""
    if contexts_col is None:
        exp = last_by_key(examples, query_col, "expected", order)
    else:
        rows = examples.filter("expected is not null").withColumn("_e", F.struct("expected", joined_contexts(contexts_col).alias("expected_contexts")))
        exp = last_by_key(rows, query_col, "_e", order).select(query_col, "_e.*")
    return (errors.join(exp, query_col, "left")
                  .withColumn("missing", F.col("expected").isNull()))


def answer_errors(scores: DataFrame, examples: DataFrame, metric: str, below: float = 1.0, key: str = "example_id",
                  query_col: str = "query", contexts_col: str | None = "reference_contexts") -> DataFrame:
    """Rows of a score table (``score_table`` with predictions) whose
    ``metric`` is below the limit, ordered by it and the key, with the
    retrieved contexts as one text and the expected answer and contexts of
    the question. A row without that score is no error."""
    bad = scores.filter(F.col(metric) < below).withColumn("contexts", joined_contexts("contexts"))
    out = attach_expected(bad, examples, query_col, "example_id", contexts_col)
    return out.orderBy(F.col(metric).asc(), F.col(key).asc_nulls_last())


# E9 --------------------------------------------------------------------------------
def examples_from_pairs(pairs: DataFrame, query_col: str = "query", answer_col: str = "reference_answer",
                        id_col: str | None = None, query_by: str = "human") -> DataFrame:
    """Curated (question, answer) rows -> labelled examples with empty
    reference contexts and a provenance tag."""
    ex_id = F.col(id_col).cast("long") if id_col else F.xxhash64(F.col(query_col))
    return pairs.select(ex_id.alias("example_id"), F.col(query_col).alias("query"),
                        F.col(answer_col).alias("reference_answer"),
                        F.array().cast("array<string>").alias("reference_contexts"),
                        F.lit(query_by).alias("query_by"))


# E10 -------------------------------------------------------------------------------
def pair_similarity(pairs: DataFrame, left_col: str, right_col: str, key: str, embedder=None,
                    dim: int = 64) -> DataFrame:
    """(key, cos) of two texts per row under an embedder: the native hashing
    embedder by default, or any ``Column -> ARRAY`` plug-in (pandas UDF)."""
    from .embed import hash_embed
    from .retrieval import cosine
    if embedder is None:
        a = hash_embed(pairs.select(key, F.col(left_col).alias("_a")), key, "_a", dim, "_va")
        b = hash_embed(pairs.select(key, F.col(right_col).alias("_b")), key, "_b", dim, "_vb")
        j = pairs.select(key).join(a, key, "left").join(b, key, "left")
    else:
        j = pairs.select(key, embedder(F.col(left_col)).alias("_va"), embedder(F.col(right_col)).alias("_vb"))
    return j.select(key, F.round(F.coalesce(cosine(F.col("_va"), F.col("_vb")), F.lit(0.0)), 6).alias("cos"))
