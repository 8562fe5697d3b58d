"""DuckDB twins of the sources and sinks (see ``queries_io``): what a written
table must give back."""

from __future__ import annotations

from .oracle_more import CHUNK_CTES, ORACLE_MORE, hash_sparse_ctes
from .queries_io import SPAN_TYPES

_TYPES = "[" + ", ".join(f"'{t}'" for t in SPAN_TYPES) + "]"

ORACLE_IO = {
    "jsonl_lines": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents",
    "partitioned_table": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'",
    "report_csv": "SELECT p_partkey, p_name, p_retailprice FROM part",
    "report_json": "SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM labels",
    "examples_file": f"""SELECT example_id, query, md5(reference_answer) AS answer_md5, 'a,' || query_by AS contexts
  FROM ({ORACLE_MORE['examples_from_pairs']})""",
    "node_store": "WITH " + CHUNK_CTES + ", nodes AS (SELECT doc || ':' || chunk_no AS node_id, doc, chunk_no, text FROM chk),"
                  + hash_sparse_ctes("nodes", "node_id", "text", "hn_") + """
SELECT n.node_id, CAST(n.doc AS BIGINT) AS doc_id, CAST(n.chunk_no AS INTEGER) AS chunk_no, md5(n.text) AS text_md5,
  CAST(CASE WHEN h.id IS NOT NULL THEN 64 END AS INTEGER) AS dim FROM nodes n LEFT JOIN hn_nrm h ON h.id = n.node_id""",
    "vector_store": "SELECT vec_id, 1.0::DOUBLE AS norm, (SELECT count(*) FROM embeddings) AS n FROM embeddings",
    "build_or_load": """WITH g AS (SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM labels WHERE quality = 1),
a AS (SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM labels)
SELECT 'first' AS step, n, ids FROM g UNION ALL SELECT 'again', n, ids FROM g UNION ALL SELECT 'anew', n, ids FROM a""",
    "trace_spans": f"""WITH s AS (SELECT event_id // 2 AS n, event_id % 2 AS e, ts FROM events),
p AS (SELECT n, min(ts) FILTER (e = 0 AND n % 7 <> 0) AS start_ts, max(ts) FILTER (e = 1) AS end_ts FROM s WHERE n % 5 < 3 GROUP BY n),
t AS (SELECT * FROM p WHERE start_ts IS NOT NULL)
SELECT CAST(t.n AS VARCHAR) AS event_id, ({_TYPES})[CAST(t.n % 5 + 1 AS INTEGER)] AS event_type,
  CAST(u.n AS VARCHAR) AS parent_id, strftime(t.start_ts, '%Y-%m-%d %H:%M:%S.%f') AS start_ts,
  strftime(t.end_ts, '%Y-%m-%d %H:%M:%S.%f') AS end_ts FROM t LEFT JOIN t u ON u.n = t.n - 1""",
}
