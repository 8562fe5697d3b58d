"""All registered queries and their SQL twins in one place."""

from __future__ import annotations

from .oracle import ORACLE as _ORACLE_1
from .oracle_io import ORACLE_IO as _ORACLE_3
from .oracle_more import ORACLE_MORE as _ORACLE_2
from .oracle_stem import ORACLE_STEM as _ORACLE_4
from .queries import QUERIES as _QUERIES_1
from .queries_io import QUERIES_IO as _QUERIES_3
from .queries_more import QUERIES_MORE as _QUERIES_2

QUERIES = {**_QUERIES_1, **_QUERIES_2, **_QUERIES_3}
ORACLE = {**_ORACLE_1, **_ORACLE_2, **_ORACLE_3, **_ORACLE_4}
# Registered without an SQL twin (row-count check by the driver): none.
ROWS_ONLY = ()
