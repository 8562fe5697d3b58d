"""Training-data operators: thirteen operators, one module each, plus their
registered queries (``queries.py``) and DuckDB twins (``oracle.py``).

Nothing outside this package imports it; the entry module adds its queries
only when it is present.
"""
