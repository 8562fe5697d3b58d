"""Every registered query against its DuckDB twin on the smallest data set
(the driver runs the same comparison at sf0.01)."""

import os

import pytest

from tests.conftest import SF_SMALL

import __spark_entry__ as entry  # noqa: E402
from tools.oracle_check import compare, duck  # noqa: E402

from revsift.plans.catalog import QUERIES  # noqa: E402

KEYS = sorted(QUERIES)
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="test data not present")
@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    fn = entry.queries()[key]
    if key not in SQL:
        df = fn(spark, SF_SMALL)
        assert df.count() >= 0
        return
    msg = compare(spark, con, SF_SMALL, key, fn, SQL[key])
    assert msg.startswith("OK"), msg


def test_every_query_has_an_oracle_or_is_declared_rows_only():
    from revsift.plans.catalog import ROWS_ONLY
    missing = set(QUERIES) - set(SQL)
    assert missing == set(ROWS_ONLY)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    assert df.count() > 0
