"""Queries that SQL can express give the rows that DuckDB gives."""

from __future__ import annotations

import pytest

from tonewright.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, found.fetchall()))
