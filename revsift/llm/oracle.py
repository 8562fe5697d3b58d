"""DuckDB twins of the operators that SQL can express: placement by the
lookup table, the source mix, and near-duplicate groups (all pairs). The
others are tested against brute force, a library or held-out labels."""

from __future__ import annotations

from ..plans.oracle import hexint
from .queries import SHARDS
from .sharding import TABLE_SIZE, fill_table

_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _numbers(values: list[int]) -> str:
    return f"CAST(unnest(string_split('{','.join(map(str, values))}', ',')) AS INTEGER)"


def sharding_sql() -> str:
    owner, fewer = fill_table(SHARDS), fill_table(SHARDS[:-1])
    return f"""WITH slots AS (SELECT CAST(unnest(generate_series(0, {TABLE_SIZE - 1})) AS INTEGER) AS slot,
  {_numbers(owner)} AS shard, {_numbers(fewer)} AS next_shard),
d AS (SELECT doc_id, CAST({hexint("coalesce(CAST(doc_id AS VARCHAR), '')", 1, 15)} % {TABLE_SIZE} AS INTEGER) AS slot FROM documents)
SELECT d.doc_id, d.slot, shard, next_shard FROM d JOIN slots ON d.slot = slots.slot"""


MIX = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS BIGINT) AS size,
  ({hexint("'mix:' || coalesce(CAST(doc_id AS VARCHAR), '')", 1, 12)} + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, sum(size * sqrt(CAST(size AS DOUBLE))) AS mass FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
  source_size * 3.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
l AS (SELECT *, cap / w AS fill, (total - coalesce(sum(cap) OVER before, 0.0::DOUBLE))
    / (sum(w) OVER () - coalesce(sum(w) OVER before, 0.0::DOUBLE)) AS level
  FROM w WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, mass,
  coalesce(least(cap, (SELECT arg_min(level, fill) FROM l WHERE fill >= level) * w), cap) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12::DOUBLE) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT *, greatest(0.0::DOUBLE, target - whole * source_size) AS lack FROM p),
r AS (SELECT d.doc_id, d.source, d.size, d.u, q.source_size, q.target, q.whole, q.lack,
  least(1 - 1e-9::DOUBLE, (CASE WHEN mass > 0 THEN lack / mass ELSE 0.0::DOUBLE END) * sqrt(CAST(size AS DOUBLE))) AS p
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, u * (1 - p) / (u * (1 - p) + (1 - u) * p) AS rank, size > 0 AND lack > 0 AS eligible FROM r),
c AS (SELECT *, sum(CASE WHEN eligible THEN size ELSE 0 END) OVER (PARTITION BY source, eligible ORDER BY rank, doc_id NULLS FIRST, size
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after,
  sum(size) OVER (PARTITION BY source, eligible, rank, doc_id, size) AS words FROM k),
x AS (SELECT *, whole + CASE WHEN eligible AND after - words < lack AND after - lack <= lack - (after - words) THEN 1 ELSE 0 END AS copies FROM c)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM x"""


NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, links.y FROM reach r JOIN links ON links.x = r.b),
g AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN g ON g.a = d.doc_id"""


ORACLE: dict[str, str] = {
    "op3_sharding": sharding_sql(),
    "op7_source_mix": MIX,
    "op8_near_duplicates": NEAR_DUPLICATES,
}
