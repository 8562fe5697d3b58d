"""DuckDB twins, part 2 (see ``queries_more``)."""

from __future__ import annotations

import re

from ..operators.answers import DEFAULT_QA_TEMPLATE
from .oracle import BENCH_Q, NL, QRELS_TEXT, SEED_SQL, atok, bm25_ctes, hexint, retrieval_metrics_sql, tok, topk

from ..functions.text import SENTENCE_PATTERN  # noqa: E402

SENT_RE = SENTENCE_PATTERN


def sql_str(s: str) -> str:
    """A Python string as a DuckDB expression (newlines via chr(10))."""
    parts = s.split("\n")
    return f" || {NL} || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def _sentences(x: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({x}, '{SENT_RE}'), lambda s: trim(s)), "
            f"lambda s: s <> '')")


def hash_sparse_ctes(src: str, idc: str, text: str, p: str) -> str:
    """Sparse hashed unit vectors {p}w(id, bucket, weight) and the id list {p}ids."""
    return f"""
{p}tk AS (SELECT {idc} AS id, unnest({tok(text)}) AS tok FROM {src}),
{p}cnt AS (SELECT id, {hexint('tok', 1, 8)} % 64 AS bucket,
                  sum(CASE WHEN {hexint('tok', 9, 1)} % 2 = 0 THEN 1 ELSE -1 END) AS c
           FROM {p}tk GROUP BY id, bucket HAVING sum(CASE WHEN {hexint('tok', 9, 1)} % 2 = 0 THEN 1 ELSE -1 END) <> 0),
{p}nrm AS (SELECT id, sqrt(CAST(sum(c * c) AS DOUBLE)) AS norm FROM {p}cnt GROUP BY id),
{p}w AS (SELECT c.id, c.bucket, c.c / n.norm AS weight FROM {p}cnt c JOIN {p}nrm n ON c.id = n.id)"""


def dense_hash_scores(q_src: str, q_id: str, q_text: str) -> str:
    """CTEs ending in dscores(q, doc, score): hashed query vs hashed document,
    every pair of non-null vectors (no shared bucket -> 0)."""
    return (hash_sparse_ctes(q_src, q_id, q_text, "hq_") + "," + hash_sparse_ctes("documents", "doc_id", "text", "hd_")
            + """,
dpairs AS (SELECT a.id AS q, b.id AS doc, sum(a.weight * b.weight) AS s
           FROM hq_w a JOIN hd_w b ON a.bucket = b.bucket GROUP BY a.id, b.id),
dscores AS (SELECT qn.id AS q, dn.id AS doc, coalesce(dp.s, 0.0) AS score
            FROM hq_nrm qn CROSS JOIN hd_nrm dn LEFT JOIN dpairs dp ON dp.q = qn.id AND dp.doc = dn.id)""")


QV = f"""SELECT item_id * 2 AS q, text FROM benchmark
  UNION ALL SELECT item_id * 2 + 1 AS q, array_to_string({atok('text')}, ' ') AS text FROM benchmark"""


def fused_ctes() -> str:
    """The question and its keyword form, each with a list by words and one by vectors."""
    return ("WITH qv AS (" + QV + ")," + bm25_ctes("SELECT * FROM qv") + "," + dense_hash_scores("qv", "q", "text")
            + f""",
lists AS (SELECT q // 2 AS q, doc, rank FROM {topk('scores', 50)}
          UNION ALL SELECT q // 2 AS q, doc, rank FROM {topk('dscores', 50)}),
fused_all AS (SELECT q, doc, sum(1.0::DOUBLE / (60 + rank)) AS score FROM lists GROUP BY q, doc),
fused AS (SELECT q, doc, score, rank FROM {topk('fused_all', 50)})""")


def overlap_sql(qt: str, dt: str) -> str:
    qd = f"list_distinct({atok(qt)})"
    dd = f"list_distinct({atok(dt)})"
    return f"(CASE WHEN len({qd}) = 0 THEN 0.0 ELSE len(list_intersect({qd}, {dd}))::DOUBLE / len({qd}) END)"


def rerank_sql(cands: str) -> str:
    return f""",
rr AS (SELECT c.q, c.doc, {overlap_sql('b.text', 'd.text')} AS score
       FROM {cands} c JOIN benchmark b ON b.item_id = c.q JOIN documents d ON d.doc_id = c.doc)
SELECT q AS item_id, rank, doc AS doc_id, round(score, 6) AS score FROM {topk('rr', 20)}"""


def vec_pairs(filter_sql: str = "", vec: str = "embedding") -> str:
    """Cosines of all pairs: dot products over the norms."""
    return f"""un AS (SELECT *, sqrt(list_dot_product(CAST({vec} AS DOUBLE[]), CAST({vec} AS DOUBLE[]))) AS norm FROM ev),
s AS (SELECT x.vec_id AS q, y.vec_id AS id,
  list_dot_product(CAST(x.{vec} AS DOUBLE[]), CAST(y.{vec} AS DOUBLE[])) / (x.norm * y.norm) AS score
  FROM un x JOIN un y ON x.vec_id <> y.vec_id {filter_sql})"""


EV_FULL = "ev AS (SELECT vec_id, label, embedding FROM embeddings)"
EV_32 = "ev AS (SELECT vec_id, label, list_slice(embedding, 1, 32) AS embedding FROM embeddings)"


def dense_sql(filter_sql: str = "") -> str:
    return (f"WITH {EV_FULL}, {vec_pairs(filter_sql)}\n"
            f"SELECT q, rank, id AS vec_id, round(score, 6) AS score FROM {topk('s', 50, idc='id')}")


def ir_sql(ev_cte: str) -> str:
    return f"""WITH {ev_cte}, {vec_pairs()},
rk AS {topk('s', 10, idc='id')},
sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
nrel AS (SELECT e.vec_id AS q, sizes.n - 1 AS n_rel FROM embeddings e JOIN sizes ON e.label = sizes.label),
hits AS (SELECT rk.q, rk.rank, row_number() OVER (PARTITION BY rk.q ORDER BY rk.rank) AS h
         FROM rk JOIN embeddings lq ON lq.vec_id = rk.q JOIN embeddings ld ON ld.vec_id = rk.id
         WHERE lq.label = ld.label),
cuts AS (SELECT unnest([1, 3, 5, 10]) AS cutoff),
per AS (SELECT hits.q, c.cutoff, count(*) AS hits, min(rank) AS first_rank,
               sum(1.0::DOUBLE / log2(rank + 1)) AS dcg, sum(h / rank) AS ap_num
        FROM hits JOIN cuts c ON hits.rank <= c.cutoff GROUP BY hits.q, c.cutoff),
base AS (SELECT n.q, c.cutoff, n.n_rel FROM nrel n CROSS JOIN cuts c WHERE n.n_rel > 0),
t AS (SELECT base.q, base.cutoff, base.n_rel, coalesce(per.hits, 0) AS hits, first_rank, dcg, ap_num
      FROM base LEFT JOIN per ON per.q = base.q AND per.cutoff = base.cutoff),
pq AS (SELECT cutoff, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS accuracy, hits::DOUBLE / cutoff AS precision,
  hits::DOUBLE / n_rel AS recall, coalesce(1.0::DOUBLE / first_rank, 0.0) AS mrr,
  coalesce(dcg, 0.0) / (SELECT sum(1.0::DOUBLE / log2(i + 1)) FROM range(1, least(n_rel, cutoff) + 1) r(i)) AS ndcg,
  coalesce(ap_num, 0.0) / least(n_rel, cutoff) AS map FROM t),
m AS (SELECT CAST(cutoff AS INTEGER) AS cutoff, avg(accuracy) AS accuracy, avg(precision) AS precision,
  avg(recall) AS recall, avg(mrr) AS mrr, avg(ndcg) AS ndcg, avg(map) AS map FROM pq GROUP BY cutoff),
longm AS (UNPIVOT m ON accuracy, precision, recall, mrr, ndcg, map INTO NAME metric VALUE value)"""


def _sentence_ctes() -> str:
    return f"""sa AS (SELECT doc_id AS doc, {_sentences('text')} AS ss FROM documents),
sents AS (SELECT doc, len(ss) AS n, unnest(ss) AS s, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS i FROM sa)"""


CHUNK_CTES = f"""{_sentence_ctes()},
tk AS (SELECT doc, n, i, unnest({tok('s')}) AS tok FROM sents),
sv AS (SELECT doc, n, i, {hexint('tok', 1, 8)} % 64 AS bucket,
              sum(CASE WHEN {hexint('tok', 9, 1)} % 2 = 0 THEN 1 ELSE -1 END) AS c FROM tk GROUP BY doc, n, i, bucket),
gv AS (SELECT doc, g, bucket, sum(c) AS v FROM (SELECT doc, n, bucket, c, unnest([i - 1, i, i + 1]) AS g FROM sv)
       WHERE g >= 0 AND g < n GROUP BY doc, g, bucket),
nrm AS (SELECT doc, g, sum(v * v) AS nn FROM gv GROUP BY doc, g),
dots AS (SELECT a.doc, a.g AS p, sum(a.v * b.v) AS dot FROM gv a JOIN gv b
         ON a.doc = b.doc AND b.g = a.g + 1 AND a.bucket = b.bucket GROUP BY a.doc, a.g),
pairs AS (SELECT doc, i AS p FROM sents WHERE i < n - 1),
dist AS (SELECT pairs.doc, pairs.p, round(1.0 - CASE WHEN nl.nn > 0 AND nr.nn > 0
           THEN CAST(coalesce(dots.dot, 0) AS DOUBLE) / (sqrt(CAST(nl.nn AS DOUBLE)) * sqrt(CAST(nr.nn AS DOUBLE)))
           ELSE 0.0 END, 9) AS d
         FROM pairs LEFT JOIN dots ON dots.doc = pairs.doc AND dots.p = pairs.p
         LEFT JOIN nrm nl ON nl.doc = pairs.doc AND nl.g = pairs.p
         LEFT JOIN nrm nr ON nr.doc = pairs.doc AND nr.g = pairs.p + 1),
thr AS (SELECT doc, quantile_cont(d, 0.95) AS thr FROM dist GROUP BY doc),
cuts AS (SELECT dist.doc, dist.p + 1 AS i, CASE WHEN d > thr THEN 1 ELSE 0 END AS cut FROM dist JOIN thr ON thr.doc = dist.doc),
lab AS (SELECT s.doc, s.i, s.s, sum(coalesce(c.cut, 0)) OVER (PARTITION BY s.doc ORDER BY s.i
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chunk_no
        FROM sents s LEFT JOIN cuts c ON c.doc = s.doc AND c.i = s.i),
chk AS (SELECT doc, chunk_no, count(*) AS n_sentences, string_agg(s, ' ' ORDER BY i) AS text FROM lab GROUP BY doc, chunk_no)"""
SEMANTIC = "WITH " + CHUNK_CTES + """
SELECT doc AS doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, n_sentences, md5(text) AS text_md5 FROM chk"""

# Search over chunks: the same nodes, numbered doc:chunk; vectors are stored as floats.
NODE_CTES = CHUNK_CTES + ", nodes AS (SELECT doc || ':' || chunk_no AS node_id, text FROM chk)"
NODE_VECTORS = hash_sparse_ctes("nodes", "node_id", "text", "hn_") + """,
nv AS (SELECT id, bucket, CAST(CAST(weight AS FLOAT) AS DOUBLE) AS w FROM hn_w),
nl AS (SELECT id, sqrt(sum(w * w)) AS len FROM nv GROUP BY id)"""
NODE_QUERIES = f"""nq AS (SELECT item_id AS q, 0 AS v, text FROM benchmark
  UNION ALL SELECT item_id AS q, 1 AS v, array_to_string({atok('text')}, ' ') AS text FROM benchmark),
nqk AS (SELECT q * 2 + v AS qv, text FROM nq)"""
NODE_SCORES = hash_sparse_ctes("nqk", "qv", "text", "hk_") + """,
ndots AS (SELECT a.id AS qv, b.id AS doc, sum(a.weight * b.w) AS s FROM hk_w a JOIN nv b ON a.bucket = b.bucket GROUP BY a.id, b.id),
nscores AS (SELECT qn.id AS qv, nl.id AS doc, coalesce(d.s, 0.0) / nl.len AS score
            FROM hk_nrm qn CROSS JOIN nl LEFT JOIN ndots d ON d.qv = qn.id AND d.doc = nl.id)"""


def node_fused() -> str:
    """CTEs ending in fused(q, doc, score, rank) over the chunks: one list by
    words, two by vectors."""
    return ("WITH RECURSIVE " + NODE_CTES + "," + bm25_ctes(BENCH_Q, src="nodes", idc="node_id") + "," + NODE_VECTORS + "," + NODE_QUERIES + ","
            + NODE_SCORES + f""",
lists AS (SELECT q, doc, rank FROM {topk('scores', 50)}
          UNION ALL SELECT qv // 2 AS q, doc, rank FROM {topk('nscores', 50, q='qv')}),
fused_all AS (SELECT q, doc, sum(1.0::DOUBLE / (60 + rank)) AS score FROM lists GROUP BY q, doc),
fused AS (SELECT q, doc, score, rank FROM {topk('fused_all', 50)})""")


BM25_CHUNKS = ("WITH " + NODE_CTES + "," + bm25_ctes(BENCH_Q, src="nodes", idc="node_id") + f"""
SELECT q AS item_id, rank, doc AS node_id, round(score, 6) AS score FROM {topk('scores', 50)}""")

HYBRID_CHUNKS = node_fused() + f""",
rr AS (SELECT c.q, c.doc, {overlap_sql('b.text', 'd.text')} AS score
       FROM fused c JOIN benchmark b ON b.item_id = c.q JOIN nodes d ON d.node_id = c.doc)
SELECT q AS item_id, rank, doc AS node_id, round(score, 6) AS score FROM {topk('rr', 20)}"""


def greedy_sql(k: int) -> str:
    """CTEs ending in fin(q, chosen): greedy choice among cand(q, id, rel)
    with csim(q, a, b, sim)."""
    return f"""first_pick AS (SELECT q, first(id ORDER BY rel DESC, id) AS id FROM cand GROUP BY q),
mmr(q, step, chosen) AS (
  SELECT q, 1, [id] FROM first_pick
  UNION ALL
  SELECT m.q, m.step + 1, list_append(m.chosen, (
      SELECT c.id FROM cand c
      WHERE c.q = m.q AND NOT list_contains(m.chosen, c.id)
      ORDER BY round(0.5 * c.rel - 0.5 * (SELECT max(x.sim) FROM csim x
                                           WHERE x.q = m.q AND x.a = c.id AND list_contains(m.chosen, x.b)), 9) DESC,
               c.id
      LIMIT 1))
  FROM mmr m
  WHERE m.step < {k} AND m.step < (SELECT count(*) FROM cand c2 WHERE c2.q = m.q)),
fin AS (SELECT q, chosen FROM (SELECT q, chosen, row_number() OVER (PARTITION BY q ORDER BY step DESC) AS r FROM mmr) WHERE r = 1)"""


MMR_CHUNKS = node_fused() + f""",
cand AS MATERIALIZED (SELECT f.q, f.doc AS id, round(s.score, 6) AS rel FROM fused f JOIN nscores s ON s.qv = f.q * 2 AND s.doc = f.doc),
pair AS (SELECT DISTINCT a.id AS a, b.id AS b FROM cand a JOIN cand b ON a.q = b.q),
psim AS MATERIALIZED (SELECT p.a, p.b, coalesce(sum(x.w * y.w), 0.0) / (any_value(la.len) * any_value(lb.len)) AS sim
         FROM pair p JOIN nl la ON la.id = p.a JOIN nl lb ON lb.id = p.b
         LEFT JOIN nv x ON x.id = p.a LEFT JOIN nv y ON y.id = p.b AND y.bucket = x.bucket GROUP BY p.a, p.b),
csim AS MATERIALIZED (SELECT a.q, p.a, p.b, p.sim FROM cand a JOIN cand b ON a.q = b.q JOIN psim p ON p.a = a.id AND p.b = b.id),
{greedy_sql(10)}
SELECT q AS item_id, CAST(generate_subscripts(chosen, 1) AS INTEGER) AS rank, unnest(chosen) AS node_id FROM fin"""

FIXED = f"""WITH t AS (SELECT doc_id, {tok('text')} AS toks FROM documents),
st AS (SELECT doc_id, toks, list_filter(range(0, len(toks), 502), lambda s: s = 0 OR s + 10 < len(toks)) AS starts
       FROM t WHERE len(toks) > 0),
ex AS (SELECT doc_id, toks, unnest(starts) AS s, CAST(generate_subscripts(starts, 1) - 1 AS INTEGER) AS chunk_no FROM st)
SELECT doc_id, chunk_no, CAST(len(list_slice(toks, s + 1, s + 512)) AS INTEGER) AS n_tokens,
       md5(array_to_string(list_slice(toks, s + 1, s + 512), ' ')) AS text_md5 FROM ex"""

WINDOWS = f"""WITH sa AS (SELECT doc_id, {_sentences('text')} AS ss FROM documents),
ex AS (SELECT doc_id, ss, len(ss) AS n, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS i FROM sa)
SELECT doc_id, i, array_to_string(list_slice(ss, greatest(i - 1, 0) + 1, least(i + 1, n - 1) + 1), ' ') AS window_text
FROM ex"""

CITATION_CTES = f"""WITH hits AS (SELECT h.item_id AS q, h.rank, d.text FROM ({fused_ctes() + rerank_sql("fused")}) h
  JOIN documents d ON d.doc_id = h.doc_id),
ctx AS (SELECT q, string_agg('Source ' || CAST(rank AS VARCHAR) || ':' || {NL} || coalesce(text, ''),
                             {NL} || {NL} ORDER BY rank) AS context FROM hits GROUP BY q)"""


def _render_sql(template: str, values: dict) -> str:
    out, pos = [], 0
    for m in re.finditer(r"\{([A-Za-z_][A-Za-z0-9_]*)\}", template):
        out.append(sql_str(template[pos:m.start()]))
        out.append(f"coalesce(CAST({values[m.group(1)]} AS VARCHAR), '')")
        pos = m.end()
    out.append(sql_str(template[pos:]))
    return " || ".join(out)


def reference_sql(min_score: float | None = None) -> str:
    """Reference blocks per order (ranks assigned before the score filter)."""
    cond = "" if min_score is None else f"WHERE score >= {float(min_score)!r}"
    return f"""WITH h AS (SELECT l.l_orderkey AS q, l.l_extendedprice AS score,
    row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey) AS r,
    coalesce(p.p_name, 'None') AS g,
    coalesce(d.text, '') || ' (Review ID: <REVIEW_ID>' || coalesce(CAST(l.l_suppkey AS VARCHAR), 'None') || '</REVIEW_ID>)' AS p0
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN documents d ON d.doc_id = l.l_suppkey),
h2 AS (SELECT q, r, g, CASE WHEN length(p0) >= 1000 THEN {NL} || {NL} || '> ...' || substr(p0, 1, 1000) || '...'
                            ELSE {NL} || {NL} || '> ' || p0 END AS p FROM h {cond}),
grp AS (SELECT q, g, min(r) AS first, string_agg(p, '' ORDER BY r) AS ps FROM h2 GROUP BY q, g)
SELECT q AS item_id, {NL} || '#### Referenced Paragraphs' || {NL}
  || string_agg('**' || g || '**' || ps || {NL} || {NL}, '' ORDER BY first) || {NL} || '    ' AS block
FROM grp GROUP BY q"""


REFERENCE = reference_sql()

APPEND = f"""WITH blocks AS ({reference_sql(30000.0)})
SELECT o.o_orderkey AS item_id,
  CASE WHEN b.block IS NULL THEN 'Order status ' || o.o_orderstatus || ', priority ' || o.o_orderpriority
       ELSE {NL} || 'Order status ' || o.o_orderstatus || ', priority ' || o.o_orderpriority || {NL} || {NL}
            || b.block || {NL} END AS response
FROM orders o LEFT JOIN blocks b ON b.item_id = o.o_orderkey"""

_SCORES = """(SELECT d.doc_id, l.quality AS relevancy, 1 - l.toxic AS correctness
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

ATTACH = f"""WITH qr AS ({QRELS_TEXT}),
src AS (SELECT q, min(doc) AS doc FROM qr GROUP BY q),
ctx AS (SELECT src.q, d.text AS expected FROM src JOIN documents d ON d.doc_id = src.doc),
ex AS (SELECT b.item_id AS example_id, b.text AS query, coalesce(ctx.expected, '') AS expected
       FROM benchmark b LEFT JOIN ctx ON ctx.q = b.item_id),
exp AS (SELECT query, arg_max(expected, example_id) AS expected FROM ex
        WHERE query IS NOT NULL AND expected IS NOT NULL GROUP BY query),
err AS (SELECT s.doc_id, b.text AS query FROM {_SCORES} s LEFT JOIN qr ON qr.doc = s.doc_id
        LEFT JOIN benchmark b ON b.item_id = qr.q WHERE s.relevancy < 1)
SELECT err.doc_id, exp.expected, exp.expected IS NULL AS missing FROM err LEFT JOIN exp ON err.query = exp.query"""

RETRIEVAL_ERRORS = ("WITH " + dense_hash_scores("(" + BENCH_Q + ")", "q", "text") + f""",
rkd AS (SELECT q, doc AS id, rank FROM {topk('dscores', 50)}),
""" + retrieval_metrics_sql("SELECT * FROM rkd", f"SELECT q, doc AS id FROM ({QRELS_TEXT})",
                            "SELECT item_id AS q FROM benchmark", 50) + """,
firsts AS (SELECT q, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS retrieved FROM rkd WHERE rank <= 10 GROUP BY q),
rtext AS (SELECT q, md5(string_agg(d.text, chr(10) || chr(10) ORDER BY rank)) AS retrieved_md5 FROM rkd JOIN documents d ON d.doc_id = rkd.id
          WHERE rank <= 10 GROUP BY q),
etext AS (SELECT q, CAST(max(n) AS BIGINT) AS n_expected, md5(string_agg(d.text, chr(10) || chr(10) ORDER BY r.id) FILTER (pos <= 10)) AS expected_md5
          FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY id) AS pos, count(*) OVER (PARTITION BY q) AS n FROM rel) r
          JOIN documents d ON d.doc_id = r.id GROUP BY q)
SELECT per_q.q AS item_id, hit_rate, mrr, precision, recall, ap, ndcg, firsts.retrieved, coalesce(n_expected, 0) AS n_expected, expected_md5, retrieved_md5
FROM per_q LEFT JOIN firsts ON firsts.q = per_q.q LEFT JOIN rtext ON rtext.q = per_q.q LEFT JOIN etext ON etext.q = per_q.q
WHERE hit_rate < 1""")

_DAYS = "['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']"
HOURS = f"""hours AS (SELECT s_suppkey AS business_id, (['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'])[dd + 1] AS day,
    CASE WHEN (s_suppkey + dd) % 7 = 0 THEN NULL ELSE CAST((s_suppkey + dd) % 12 AS INTEGER) END AS open_hour,
    CASE WHEN (s_suppkey + dd) % 7 = 0 THEN NULL ELSE CAST((s_suppkey + dd) % 12 + s_nationkey % 13 AS INTEGER) END AS close_hour
  FROM supplier CROSS JOIN (SELECT unnest(range(7)) AS dd))"""


def _avail(ts: str) -> str:
    return f"""coalesce(h.open_hour <= hour({ts}) AND hour({ts}) < h.close_hour, false)"""


def slot_sql(bid: str, ts: str) -> str:
    seed = SEED_SQL.replace("CAST(user_id AS VARCHAR)", f"CAST({bid} AS VARCHAR)").replace("strftime(ts,", f"strftime({ts},")
    return f"(CASE WHEN ({seed}) % 5 = 0 THEN 0 ELSE 1 + (({seed}) // 5) % 10 END)"


# Greedy MMR as a recursive CTE: each step appends the candidate with the
# best round(0.5*rel - 0.5*max sim to the chosen, 9), ties by id.
MMR = f"""WITH RECURSIVE {EV_FULL}, {vec_pairs()},
cand AS (SELECT q, id, round(score, 6) AS rel FROM {topk('s', 50, idc='id')}),
csim AS (SELECT a.q, a.id AS a, b.id AS b,
           list_dot_product(CAST(ea.embedding AS DOUBLE[]), CAST(eb.embedding AS DOUBLE[])) / (ea.norm * eb.norm) AS sim
         FROM cand a JOIN cand b ON a.q = b.q JOIN un ea ON ea.vec_id = a.id
         JOIN un eb ON eb.vec_id = b.id),
first_pick AS (SELECT q, arg_max(id, (rel, -id)) AS id FROM cand GROUP BY q),
mmr(q, step, chosen) AS (
  SELECT q, 1, [id] FROM first_pick
  UNION ALL
  SELECT m.q, m.step + 1, list_append(m.chosen, (
      SELECT c.id FROM cand c
      WHERE c.q = m.q AND NOT list_contains(m.chosen, c.id)
      ORDER BY round(0.5 * c.rel - 0.5 * (SELECT max(x.sim) FROM csim x
                                           WHERE x.q = m.q AND x.a = c.id AND list_contains(m.chosen, x.b)), 9) DESC,
               c.id
      LIMIT 1))
  FROM mmr m
  WHERE m.step < 10 AND m.step < (SELECT count(*) FROM cand c2 WHERE c2.q = m.q)),
fin AS (SELECT q, chosen FROM (SELECT q, chosen, row_number() OVER (PARTITION BY q ORDER BY step DESC) AS r FROM mmr) WHERE r = 1)
SELECT q, CAST(generate_subscripts(chosen, 1) AS INTEGER) AS rank, unnest(chosen) AS vec_id FROM fin"""


AVAIL_ROWS = f"""WITH {HOURS},
  r AS (SELECT event_id, user_id, 1 + event_id % 8 AS pax,
          unnest(generate_series(ts, ts + to_hours(event_id % 6 - 1), INTERVAL 1 HOUR)) AS t FROM events),
  ar AS (SELECT r.event_id, strftime(r.t, '%Y-%m-%d %H:00') AS hour,
           {_avail('r.t')} AND {slot_sql('r.user_id', 'r.t')} >= r.pax AS ok
         FROM r LEFT JOIN hours h ON h.business_id = r.user_id AND h.day = dayname(r.t))"""

PAIR_SIM = ("WITH qr AS (" + QRELS_TEXT + "),"
            + hash_sparse_ctes("benchmark", "item_id", "text", "hq_") + ","
            + hash_sparse_ctes("documents", "doc_id", "text", "hd_") + """,
dp AS (SELECT qr.q, qr.doc, sum(a.weight * b.weight) AS s
       FROM qr JOIN hq_w a ON a.id = qr.q JOIN hd_w b ON b.id = qr.doc AND b.bucket = a.bucket
       GROUP BY qr.q, qr.doc)
SELECT qr.q AS item_id, qr.doc AS doc_id, round(coalesce(dp.s, 0.0), 6) AS cos
FROM qr LEFT JOIN dp ON dp.q = qr.q AND dp.doc = qr.doc""")

def _contexts(a: str, b: str) -> str:
    """Two contexts as one text, a blank line between them, nulls left out."""
    return f"(CASE WHEN {a} IS NULL AND {b} IS NULL THEN NULL ELSE concat_ws({NL} || {NL}, {a}, {b}) END)"


ORACLE_MORE = {
    "sql_functions": f"""SELECT event_id, CAST({slot_sql('user_id', 'ts')} AS INTEGER) AS slots,
  coalesce(user_id % 12 <= hour(ts) AND hour(ts) < user_id % 12 + 8, false) AS open_flag FROM events""",
    "examples_from_pairs": """SELECT conv_id * 100000 + turn AS example_id, text AS query, nt AS reference_answer,
  CAST(0 AS INTEGER) AS n_contexts, 'human' AS query_by
  FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND nr = 'assistant' AND nt IS NOT NULL""",
    "append_references": APPEND,
    "availability_json": AVAIL_ROWS + """
SELECT e.event_id, coalesce(j.availability, '{}') AS availability FROM events e LEFT JOIN (
  SELECT event_id, CAST(to_json(map_from_entries(list({'k': hour, 'v': ok} ORDER BY hour))) AS VARCHAR) AS availability
  FROM ar GROUP BY event_id) j ON j.event_id = e.event_id""",
    "pair_similarity": PAIR_SIM,
    "score_table": f"""SELECT s.doc_id, d.lang AS query, md5(d.text) AS answer_md5, CAST(relevancy AS DOUBLE) AS relevancy,
  CAST(correctness AS DOUBLE) AS correctness, {_contexts('d.lang', 'd.source')} AS contexts
  FROM {_SCORES} s JOIN documents d ON d.doc_id = s.doc_id""",
    "answer_errors": f"""WITH good AS (SELECT d.* FROM documents d WHERE lang <> 'en'
    AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1 AND toxic = 0)),
  ex AS (SELECT lang AS query, arg_max(text, doc_id) AS expected, arg_max({_contexts('source', 'lang')}, doc_id) AS expected_contexts
         FROM good WHERE text IS NOT NULL GROUP BY lang)
SELECT s.doc_id, d.lang AS query, CAST(relevancy AS DOUBLE) AS relevancy, CAST(correctness AS DOUBLE) AS correctness,
  {_contexts('d.lang', 'd.source')} AS contexts, md5(expected) AS expected_md5, expected_contexts, expected IS NULL AS missing
FROM {_SCORES} s JOIN documents d ON d.doc_id = s.doc_id LEFT JOIN ex ON ex.query = d.lang WHERE relevancy < 1""",
    "count_params": """SELECT 'n_documents' AS name, CAST(count(*) AS DOUBLE) AS value FROM documents
UNION ALL SELECT 'n_good_documents', CAST(count(*) AS DOUBLE) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
UNION ALL SELECT 'n_user_turns', CAST(count(*) AS DOUBLE) FROM conversations WHERE role = 'user'""",
    "make_pairs": f"""SELECT p.q AS item_id, b.text AS question, p.doc AS doc_id, md5(d.text) AS text_md5
  FROM (SELECT DISTINCT q, doc FROM ({QRELS_TEXT})) p JOIN benchmark b ON b.item_id = p.q JOIN documents d ON d.doc_id = p.doc""",
    "mmr_topk": MMR,
    "bm25_chunks": BM25_CHUNKS,
    "hybrid_search_chunks": HYBRID_CHUNKS,
    "mmr_search_chunks": MMR_CHUNKS,
    "dense_topk": dense_sql(),
    "filtered_dense": dense_sql("AND y.label >= 2 AND y.label < 7"),
    "score_cutoff": f"WITH {EV_FULL}, {vec_pairs()}\nSELECT q, id AS vec_id, round(score, 6) AS score FROM "
                    f"{topk('s', 50, idc='id')} WHERE round(score, 6) >= 0.25",
    "hash_embed": "WITH " + hash_sparse_ctes("documents", "doc_id", "text", "")
                  + "\nSELECT id AS doc_id, CAST(bucket AS INTEGER) AS bucket, round(weight, 6) AS weight FROM w",
    "rrf_fusion": fused_ctes() + "\nSELECT q AS item_id, rank, doc AS doc_id, round(score, 6) AS score FROM fused",
    "hybrid_search": fused_ctes() + rerank_sql("fused"),
    "rerank_overlap": f"WITH {bm25_ctes(BENCH_Q)},\nbm AS {topk('scores', 50)}" + rerank_sql("bm"),
    "sentence_windows": WINDOWS,
    "semantic_chunks": SEMANTIC,
    "fixed_chunks": FIXED,
    "topk_per_query": f"""WITH price AS (SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 6) AS price
      FROM lineitem GROUP BY l_orderkey),
  j AS (SELECT o.o_custkey AS custkey, p.l_orderkey, p.price FROM orders o JOIN price p ON p.l_orderkey = o.o_orderkey)
SELECT custkey, rank, l_orderkey AS orderkey, price FROM {topk('j', 5, q='custkey', idc='l_orderkey', score='price')}""",
    "citation_context": CITATION_CTES + "\nSELECT q AS item_id, context FROM ctx",
    "render_prompt": CITATION_CTES + "\nSELECT b.item_id, " + _render_sql(
        DEFAULT_QA_TEMPLATE, {"context_str": "ctx.context", "query_str": "b.text"})
        + " AS prompt FROM benchmark b LEFT JOIN ctx ON ctx.q = b.item_id",
    "reference_block": REFERENCE,
    "fetch_nodes": f"""WITH {bm25_ctes(BENCH_Q)}
SELECT h.q AS item_id, CAST(h.rank - 1 AS INTEGER) AS pos, d.n_chars
FROM {topk('scores', 10)} h JOIN documents d ON d.doc_id = h.doc""",
    "attach_expected": ATTACH,
    "zip_scores": """SELECT d.doc_id, l.quality AS relevancy, 1 - l.toxic AS correctness
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "ir_report": ir_sql(EV_FULL) + "\nSELECT cutoff, metric, round(value, 6) AS value FROM longm",
    "compare_models": "WITH full_r AS (" + ir_sql(EV_FULL) + " SELECT cutoff, metric, round(value, 6) AS value FROM longm),"
                      + "\ndim_r AS (" + ir_sql(EV_32) + " SELECT cutoff, metric, round(value, 6) AS value FROM longm)"
                      + """
SELECT f.metric || '@' || CAST(f.cutoff AS VARCHAR) AS metric, f.value AS "full", d.value AS dim32
FROM full_r f JOIN dim_r d ON f.metric = d.metric AND f.cutoff = d.cutoff""",
    "retrieval_errors": RETRIEVAL_ERRORS,
    "score_summary": f"""SELECT metric, round(avg(score), 6) AS mean FROM (
  SELECT 'relevancy' AS metric, CAST(relevancy AS DOUBLE) AS score FROM {_SCORES}
  UNION ALL SELECT 'correctness', CAST(correctness AS DOUBLE) FROM {_SCORES}) GROUP BY metric""",
    "parse_hours": f"WITH {HOURS} SELECT business_id, day, open_hour, close_hour FROM hours",
    "is_open": f"""WITH {HOURS} SELECT e.event_id, {_avail('e.ts')} AS is_open
  FROM events e LEFT JOIN hours h ON h.business_id = e.user_id AND h.day = dayname(e.ts)""",
    "check_availability": f"""WITH {HOURS} SELECT e.event_id,
  {_avail('e.ts')} AND {slot_sql('e.user_id', 'e.ts')} >= 1 + e.event_id % 8 AS ok
  FROM events e LEFT JOIN hours h ON h.business_id = e.user_id AND h.day = dayname(e.ts)""",
    "availability_range": f"""WITH {HOURS},
  r AS (SELECT event_id, user_id, 1 + event_id % 8 AS pax,
          unnest(generate_series(ts, ts + to_hours(event_id % 6 - 1), INTERVAL 1 HOUR)) AS t FROM events)
SELECT r.event_id, strftime(r.t, '%Y-%m-%d %H:00') AS hour,
  {_avail('r.t')} AND {slot_sql('r.user_id', 'r.t')} >= r.pax AS ok
  FROM r LEFT JOIN hours h ON h.business_id = r.user_id AND h.day = dayname(r.t)""",
}
