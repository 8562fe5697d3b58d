"""DuckDB twin of the stemmed BM25 search: the suffix stemmer as one common
table per step over the distinct words of documents and queries."""

from __future__ import annotations

from ..functions.stem import STEP2, STEP3, STEP4
from .oracle import BENCH_Q, atok, topk

# w: the word so far, s: its letters as c and v, n: its length
SHAPE = """translate(replace(regexp_replace(w, '([^aeiouy])y', '\\1i', 'g'), 'yy', 'yi'),
    'abcdefghijklmnopqrstuvwxyz', 'vcccvcccvcccccvcccccvccccc')"""
SOME = "regexp_matches({s}, 'vc')"
MANY = "regexp_matches({s}, 'vc.*vc')"
DOUBLE = "(n >= 2 AND w[n] = w[n - 1] AND s[n] = 'c')"


def _cvc(w: str, s: str) -> str:
    return f"(regexp_matches({s}, 'cvc$') AND NOT regexp_matches({w}, '[wxy]$'))"


def _step(name: str, prev: str, columns: str) -> str:
    return f"{name} AS (SELECT term, {columns} FROM (SELECT *, {SHAPE} AS s, length(w) AS n FROM {prev}))"


def _suffixes(name: str, prev: str, suffixes, case: str) -> str:
    """One rule of suffixes; f: the suffix found, t: the stem, ts: its shape."""
    return f"""{name} AS (SELECT term, CASE WHEN f = '' THEN w {case} ELSE w END AS w FROM (
  SELECT *, w[1:n - length(f)] AS t, s[1:n - length(f)] AS ts FROM (
    SELECT *, {SHAPE} AS s, length(w) AS n, regexp_extract(w, '({"|".join(suffixes)})$', 1) AS f FROM {prev})))"""


def _replaced(rules) -> str:
    return f"WHEN {SOME.format(s='ts')} THEN t || CASE f " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules) + " END"


def stem_ctes(words_sql: str) -> str:
    """stems(term, stem) of the words of a query with one column ``term``."""
    return ",\n".join([
        f"voc AS (SELECT DISTINCT term FROM ({words_sql}) WHERE term IS NOT NULL)",
        "w0 AS (SELECT term, term AS w FROM voc WHERE regexp_full_match(term, '[a-z]{3,}'))",
        _step("w1a", "w0", """CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN w[1:n - 2]
            WHEN suffix(w, 'ss') THEN w WHEN suffix(w, 's') THEN w[1:n - 1] ELSE w END AS w"""),
        _step("w1b", "w1a", f"""CASE WHEN suffix(w, 'eed') THEN CASE WHEN {SOME.format(s="s[1:n - 3]")} THEN w[1:n - 1] ELSE w END
            WHEN suffix(w, 'ed') AND contains(s[1:n - 2], 'v') THEN w[1:n - 2]
            WHEN suffix(w, 'ing') AND contains(s[1:n - 3], 'v') THEN w[1:n - 3] ELSE w END AS w,
            (suffix(w, 'ed') AND NOT suffix(w, 'eed') AND contains(s[1:n - 2], 'v'))
            OR (suffix(w, 'ing') AND contains(s[1:n - 3], 'v')) AS cut"""),
        _step("w1m", "w1b", f"""CASE WHEN NOT cut THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e'
            WHEN {DOUBLE} AND NOT regexp_matches(w, '[lsz]$') THEN w[1:n - 1]
            WHEN {SOME.format(s="s")} AND NOT {MANY.format(s="s")} AND {_cvc("w", "s")} THEN w || 'e' ELSE w END AS w"""),
        _step("w1c", "w1m", "CASE WHEN suffix(w, 'y') AND contains(s[1:n - 1], 'v') THEN w[1:n - 1] || 'i' ELSE w END AS w"),
        _suffixes("w2", "w1c", [a for a, _ in STEP2], _replaced(STEP2)),
        _suffixes("w3", "w2", [a for a, _ in STEP3], _replaced(STEP3)),
        _suffixes("w4", "w3", STEP4, f"WHEN {MANY.format(s='ts')} AND (f <> 'ion' OR regexp_matches(t, '[st]$')) THEN t"),
        _step("w5a", "w4", f"""CASE WHEN suffix(w, 'e') AND ({MANY.format(s="s[1:n - 1]")}
            OR ({SOME.format(s="s[1:n - 1]")} AND NOT {_cvc("w[1:n - 1]", "s[1:n - 1]")})) THEN w[1:n - 1] ELSE w END AS w"""),
        _step("w5b", "w5a", f"CASE WHEN suffix(w, 'l') AND {DOUBLE} AND {MANY.format(s='s')} THEN w[1:n - 1] ELSE w END AS w"),
        "stems AS (SELECT voc.term, coalesce(w5b.w, voc.term) AS stem FROM voc LEFT JOIN w5b USING (term))"])


ORACLE_STEM = {
    "bm25_stemmed": f"""WITH dtok AS (SELECT doc_id, {atok('text')} AS toks FROM documents),
dterm AS (SELECT doc_id AS doc, len(toks) AS dl, unnest(toks) AS term FROM dtok),
qterm AS (SELECT q, unnest({atok('text')}) AS term FROM ({BENCH_Q})),
stats AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM dtok),
{stem_ctes("SELECT term FROM dterm UNION ALL SELECT term FROM qterm")},
post AS (SELECT doc, dl, stem, count(*) AS tf FROM dterm JOIN stems USING (term) GROUP BY ALL),
dfreq AS (SELECT stem, count(*) AS df FROM post GROUP BY stem),
qt AS (SELECT q, stem, count(*) AS qtf FROM qterm JOIN stems USING (term) GROUP BY ALL),
scores AS (SELECT q, doc, sum(qtf * ln(1.0::DOUBLE + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE
             / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM qt JOIN post USING (stem) JOIN dfreq USING (stem) CROSS JOIN stats GROUP BY q, doc)
SELECT q AS item_id, rank, doc AS doc_id, round(score, 6) AS score FROM {topk('scores', 50)}""",
}
