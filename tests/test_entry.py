"""The driver's contract."""

import __spark_entry__ as entry


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) >= 40 and set(oracles) <= set(queries) and len(oracles) >= 35
    assert all(callable(f) for f in queries.values()) and all(isinstance(s, str) for s in oracles.values())
