"""DuckDB twins of the registered queries (tables are pre-registered views).

These restate each query's definition in plain SQL; they are the
correctness oracle, not an execution path.
"""

from __future__ import annotations

from ..functions.text import STOP_WORDS, TOKEN_PATTERN

# the fixed values of revsift.functions.text, as SQL
STOP_LIST = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
TOKENS = "regexp_extract_all(lower({x}), '" + TOKEN_PATTERN.replace("{", "{{").replace("}", "}}") + "')"


def tok(x: str) -> str:
    return TOKENS.format(x=x)


def atok(x: str) -> str:
    """Analysed tokens: stop words removed."""
    return f"list_filter({tok(x)}, lambda t: NOT list_contains({STOP_LIST}, t))"


def hexint(x: str, a: int, n: int) -> str:
    return f"('0x' || substr(md5({x}), {a}, {n}))::BIGINT"


# BM25 over documents for a query relation Q(q, text) -> scores(q, doc, score)
def bm25_ctes(queries_sql: str, prefix: str = "", src: str = "documents", idc: str = "doc_id") -> str:
    p = prefix
    return f"""
{p}dtok AS (SELECT {idc} AS doc_id, {atok('text')} AS toks FROM {src}),
{p}stats AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM {p}dtok),
{p}post AS (SELECT doc, dl, term, count(*) AS tf
          FROM (SELECT doc_id AS doc, len(toks) AS dl, unnest(toks) AS term FROM {p}dtok)
          GROUP BY doc, dl, term),
{p}dfreq AS (SELECT term, count(*) AS df FROM {p}post GROUP BY term),
{p}qt AS (SELECT q, term, count(*) AS qtf
        FROM (SELECT q, unnest({atok('text')}) AS term FROM ({queries_sql}))
        GROUP BY q, term),
{p}scores AS (
  SELECT qt.q, p.doc,
         sum(qt.qtf * ln(1.0::DOUBLE + (s.n_docs - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE))
             * p.tf * 2.5::DOUBLE
             / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / s.avgdl))) AS score
  FROM {p}qt qt JOIN {p}post p ON qt.term = p.term JOIN {p}dfreq f ON f.term = qt.term
  CROSS JOIN {p}stats s
  GROUP BY qt.q, p.doc)"""


def topk(src: str, k: int, q: str = "q", idc: str = "doc", score: str = "score") -> str:
    return f"""(SELECT * FROM (SELECT {q}, {idc}, {score},
        CAST(row_number() OVER (PARTITION BY {q} ORDER BY round({score}, 6) DESC, {idc}) AS INTEGER) AS rank
        FROM {src}) WHERE rank <= {k})"""


BENCH_Q = "SELECT item_id AS q, text FROM benchmark"

QRELS_TEXT = """SELECT b.item_id AS q, d.doc_id AS doc FROM benchmark b JOIN documents d
  ON length(b.text) > 0 AND instr(d.text, b.text) > 0"""


def retrieval_metrics_sql(ranked_sql: str, qrels_sql: str, queries_sql: str, k: int) -> str:
    return f"""
rk AS (SELECT DISTINCT ON (q, id) q, id, rank FROM ({ranked_sql}) WHERE rank <= {k} ORDER BY q, id, rank),
rel AS (SELECT DISTINCT q, id FROM ({qrels_sql})),
hits AS (SELECT rk.q, rk.id, rk.rank, row_number() OVER (PARTITION BY rk.q ORDER BY rk.rank) AS h
         FROM rk JOIN rel ON rk.q = rel.q AND rk.id = rel.id),
ph AS (SELECT q, count(*) AS n_hits, min(rank) AS first_rank, sum(h / rank) AS ap_num,
              sum(1.0::DOUBLE / log2(rank + 1)) AS dcg FROM hits GROUP BY q),
pr AS (SELECT q, count(*) AS n_ret FROM rk GROUP BY q),
pe AS (SELECT q, count(*) AS n_rel FROM rel GROUP BY q),
base AS (SELECT DISTINCT q FROM ({queries_sql})),
t AS (SELECT base.q, coalesce(n_rel, 0) AS n_rel, coalesce(n_ret, 0) AS n_ret,
             coalesce(n_hits, 0) AS n_hits, first_rank, ap_num, dcg
      FROM base LEFT JOIN pe USING (q) LEFT JOIN pr USING (q) LEFT JOIN ph USING (q)),
per_q AS (SELECT q,
  round(CASE WHEN n_rel > 0 THEN CASE WHEN n_hits > 0 THEN 1.0 ELSE 0.0 END END, 6)::DOUBLE AS hit_rate,
  round(CASE WHEN n_rel > 0 THEN coalesce(1.0::DOUBLE / first_rank, 0.0) END, 6)::DOUBLE AS mrr,
  round(CASE WHEN n_rel > 0 THEN CASE WHEN n_ret > 0 THEN n_hits::DOUBLE / n_ret ELSE 0.0 END END, 6)::DOUBLE AS precision,
  round(CASE WHEN n_rel > 0 THEN n_hits::DOUBLE / n_rel END, 6)::DOUBLE AS recall,
  round(CASE WHEN n_rel > 0 THEN coalesce(ap_num, 0.0) / n_rel END, 6)::DOUBLE AS ap,
  round(CASE WHEN n_rel > 0 THEN coalesce(dcg, 0.0) /
        (SELECT sum(1.0::DOUBLE / log2(i + 1)) FROM range(1, least(n_rel, {k}) + 1) r(i)) END, 6)::DOUBLE AS ndcg
  FROM t)"""


def _bm25_per_q() -> str:
    ranked = f"SELECT q, doc AS id, rank FROM {topk('scores', 50)}"
    qrels = f"SELECT q, doc AS id FROM ({QRELS_TEXT})"
    return (f"WITH {bm25_ctes(BENCH_Q)},\n"
            + retrieval_metrics_sql(ranked, qrels, "SELECT item_id AS q FROM benchmark", 50))


def _summary(per_q_with: str, prefix: str) -> str:
    names = ["hit_rate", "mrr", "precision", "recall", "ap", "ndcg"]
    parts = [f"SELECT '{prefix}_{n}' AS name, round(avg({n}), 6)::DOUBLE AS value FROM per_q" for n in names]
    parts.append(f"SELECT '{prefix}_n_queries' AS name, round(count(*)::DOUBLE, 6) AS value FROM per_q")
    parts.append(f"SELECT '{prefix}_n_queries_without_relevant' AS name, "
                 f"round(sum(CASE WHEN hit_rate IS NULL THEN 1 ELSE 0 END)::DOUBLE, 6) AS value FROM per_q")
    return per_q_with + "\n" + "\nUNION ALL\n".join(parts)


ORACLE = {
    "bm25_topk": f"""WITH {bm25_ctes(BENCH_Q)}
SELECT q AS item_id, rank, doc AS doc_id, round(score, 6) AS score FROM {topk('scores', 50)}""",
    "passage_qrels": f"SELECT q AS item_id, doc AS doc_id FROM ({QRELS_TEXT})",
    "retrieval_metrics": _bm25_per_q() + "\nSELECT q AS item_id, hit_rate, mrr, precision, recall, ap, ndcg FROM per_q",
    "retrieval_summary": _summary(_bm25_per_q(), "top_50_retrieval_eval"),
}


# ==================================================================================
# Sources, preparation, joins, aggregations
# ==================================================================================
NL = "chr(10)"
from ..functions.text import PUNCT_CLASS  # noqa: E402  (the same plain punctuation list)

PUNCT_RE = PUNCT_CLASS.replace("'", "''")  # as the body of a SQL string literal


def sha_mod_sql(x: str, m: int = 10 ** 8) -> str:
    acc = "0::BIGINT"
    for i in range(8):
        acc = f"(({acc}) * 4294967296 + ('0x' || substr(sha256({x}), {8 * i + 1}, 8))::BIGINT) % {m}"
    return acc


def to_number_sql(x: str) -> str:
    return f"coalesce(TRY_CAST(trim({x}) AS BIGINT)::DOUBLE, TRY_CAST(trim({x}) AS DOUBLE))"


SEED_SQL = sha_mod_sql("CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y-%m-%d_%H')")

_PROFILE_NUM = {"part": ["p_partkey", "p_size", "p_retailprice"], "events": ["event_id", "user_id", "value"]}
_PROFILE_STR = {"part": ["p_name", "p_brand", "p_type"], "events": ["ts", "event_type", "props"]}


def _profile_sql() -> str:
    num = " UNION ALL ".join(f"SELECT '{t}.{c}' AS col, CAST({c} AS DOUBLE) AS x FROM {t}"
                             for t, cs in _PROFILE_NUM.items() for c in cs)
    st = " UNION ALL ".join(f"SELECT '{t}.{c}' AS col, CAST({c} AS VARCHAR) AS x FROM {t}"
                            for t, cs in _PROFILE_STR.items() for c in cs)
    return f"""WITH num AS ({num}), st AS ({st}),
ns AS (SELECT col, count(*) AS count, count(DISTINCT x) AS "unique", NULL::VARCHAR AS top, NULL::BIGINT AS freq,
  round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min,
  round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50,
  round(quantile_cont(x, 0.75), 6) AS p75, round(max(x), 6) AS max
  FROM num WHERE x IS NOT NULL GROUP BY col),
vc AS (SELECT col, x, count(*) AS c FROM st WHERE x IS NOT NULL GROUP BY col, x),
ss AS (SELECT col, CAST(sum(c) AS BIGINT) AS count, count(*) AS "unique", first(x ORDER BY c DESC, x) AS top,
  max(c) AS freq, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS p25,
  NULL::DOUBLE AS p50, NULL::DOUBLE AS p75, NULL::DOUBLE AS max FROM vc GROUP BY col)
SELECT col AS "column", count, "unique", top, freq, mean, std, min, p25, p50, p75, max FROM ns
UNION ALL SELECT col AS "column", count, "unique", top, freq, mean, std, min, p25, p50, p75, max FROM ss"""


_SCORES = """(SELECT d.doc_id, l.quality AS relevancy, 1 - l.toxic AS correctness
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

_MATCH = "regexp_matches(p_name, '(?i)RING|gear')"

ORACLE.update({
    "scan_parquet": "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total_chars FROM documents GROUP BY lang",
    "qa_maps_explode": f"SELECT DISTINCT q AS query_id, doc AS doc_id FROM ({QRELS_TEXT})",
    "vector_table_stats": """SELECT count(*) AS n, CAST(max(len(embedding)) AS INTEGER) AS dim,
  round(min(nrm), 6) AS min_norm, round(max(nrm), 6) AS max_norm
  FROM (SELECT embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nrm
        FROM embeddings)""",
    "collect_log": f"""WITH lines AS (SELECT event_id AS line_no,
    '[COLLECT] ' || event_type || '(n)=' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || ' ' AS line FROM events),
  kv AS (SELECT line_no, regexp_replace(regexp_extract(line, '\\[COLLECT\\]\\s*(.+?)=(.+?)\\s', 1), '{PUNCT_RE}', '_', 'g') AS key,
    {to_number_sql("regexp_extract(line, '\\[COLLECT\\]\\s*(.+?)=(.+?)\\s', 2)")} AS value
    FROM lines WHERE regexp_matches(line, '\\[COLLECT\\]\\s*(.+?)=(.+?)\\s'))
SELECT key, arg_max(value, line_no) AS value FROM kv GROUP BY key""",
    "metrics_long": """SELECT 'response_labels_eval__n_labels' AS name, round(count(*)::DOUBLE, 6) AS value FROM labels
UNION ALL SELECT 'response_labels_eval__quality', round(avg(quality), 6) FROM labels
UNION ALL SELECT 'response_labels_eval__toxic', round(avg(toxic), 6) FROM labels""",
    "drop_missing": """SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  WHERE l.quality IS NOT NULL""",
    "match_any": f"SELECT p_partkey, p_name FROM part WHERE {_MATCH}",
    "prefix_columns": "SELECT c_custkey AS custkey, c_name AS cust_name, c_acctbal AS cust_acctbal FROM customer",
    "build_documents": f"""SELECT l.l_orderkey, l.l_linenumber,
  'l_returnflag: ' || coalesce(l.l_returnflag, 'None') || {NL} || 'l_linestatus: ' || coalesce(l.l_linestatus, 'None')
  || {NL} || 'p_brand: ' || coalesce(p.p_brand, 'None') || {NL} || 'p_type: ' || coalesce(p.p_type, 'None')
  || {NL} || {NL} || coalesce(p.p_name, '') AS embed_text
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey""",
    "error_rows": f"SELECT doc_id, relevancy, correctness FROM {_SCORES} WHERE relevancy < 1",
    "filter_spec": "SELECT p_partkey, p_size, p_brand FROM part WHERE p_size >= 10 AND p_size < 30 AND p_type <> 'SMALL'",
    "stringify_nulls": """SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'None') AS quality_text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "first_n": "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20",
    "cascade_semi": f"""WITH b AS (SELECT * FROM part WHERE {_MATCH}),
  r AS (SELECT * FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM b)),
  u AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM r))
SELECT 'part' AS table_name, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS key_sum FROM b
UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM r
UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM u""",
    "join_m1": """SELECT o.o_orderkey, c.c_name AS cust_name, c.c_mktsegment AS cust_mktsegment
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""",
    "last_by_key": """SELECT p_name, arg_max(p_partkey, p_partkey) AS p_partkey FROM part
  WHERE p_name IS NOT NULL AND p_partkey IS NOT NULL GROUP BY p_name""",
    "category_share": """WITH t AS (SELECT count(*) AS total FROM part WHERE p_name IS NOT NULL),
  c AS (SELECT category, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS category FROM part) GROUP BY category)
SELECT category, n, total, round(100.0::DOUBLE * n / total, 6) AS perc FROM c, t""",
    "profile": _profile_sql(),
    "distinct_ids": "SELECT count(DISTINCT l_partkey) AS partkeys, count(DISTINCT l_suppkey) AS suppkeys FROM lineitem",
    "term_stats": f"""WITH dtok AS (SELECT doc_id, {atok('text')} AS toks FROM documents),
  post AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(toks) AS term FROM dtok))
SELECT term, count(*) AS df FROM post GROUP BY term""",
    "iso_dates": "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS text FROM orders",
    "hour_parts": """SELECT event_id, text, dayname(t) AS weekday, CAST(hour(t) AS INTEGER) AS hour,
  strftime(t, '%Y-%m-%d %H:00') AS label
  FROM (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS text,
               CAST(strftime(ts, '%Y-%m-%dT%H:%M:%S') AS TIMESTAMP) AS t FROM events)""",
    "depunct": f"SELECT page_id AS id, regexp_replace(url, '{PUNCT_RE}', '_', 'g') AS value FROM pages",
    "to_number": f"""SELECT p_partkey AS id, {to_number_sql('s')} AS value, TRY_CAST(trim(s) AS BIGINT) IS NOT NULL AS is_int,
  {to_number_sql('p_type')} AS type_value FROM (SELECT *, split_part(p_brand, '#', 2) AS s FROM part)""",
    "flatten_struct": """SELECT event_id, event_type AS meta__event_type,
  CAST(json_extract(props, '$.k') AS INTEGER) AS meta__props__k FROM events""",
    "sha_bucket": f"SELECT event_id, {SEED_SQL} AS seed FROM events",
    "slot_count": f"""SELECT event_id, CASE WHEN seed % 5 = 0 THEN 0 ELSE CAST(1 + (seed // 5) % 10 AS INTEGER) END AS slots
  FROM (SELECT event_id, {SEED_SQL} AS seed FROM events)""",
    "pair_cosine": """SELECT a, b, round(CASE WHEN na > 0 AND nb > 0 THEN dt / (sqrt(na) * sqrt(nb)) END, 6) AS cos FROM (
  SELECT x.vec_id AS a, y.vec_id AS b,
    list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS dt,
    list_sum(list_transform(x.embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) AS na,
    list_sum(list_transform(y.embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) AS nb
  FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)""",
    "keyword_query": f"SELECT item_id, array_to_string({atok('text')}, ' ') AS keywords FROM benchmark",
    "pair_turns": """SELECT conv_id, turn, text AS user_text, CASE WHEN nr = 'assistant' THEN nt END AS reply_text
  FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""",
    "sample_exact": "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 30",
    "sample_repl": f"""WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CAST(draw AS INTEGER) AS draw FROM (SELECT range AS draw FROM range(30)) d
  JOIN k ON k.r = {hexint("'42:' || draw", 1, 15)} % k.n + 1 WHERE draw < n""",
    "group_split": """WITH k AS (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL),
  r AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('42:' || o_custkey), o_custkey) AS rn FROM k),
  n AS (SELECT count(*) AS n FROM k),
  tr AS (SELECT o_custkey FROM r, n WHERE rn <= floor(n * 0.7::DOUBLE))
SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM tr) THEN 'train' ELSE 'val' END AS side FROM orders""",
})
