"""The training-data queries with a DuckDB twin, side by side."""

import pytest

from revsift.llm.oracle import ORACLE
from revsift.llm.queries import QUERIES

from .conftest import SMALL


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_its_twin(spark, key):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    want = con.execute(ORACLE[key]).fetchall()
    names = [c[0] for c in con.description]
    df = QUERIES[key](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(want)
