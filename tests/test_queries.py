"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import pytest

from tonewright.plans import audio, context, evidence, packets, performance, priors, relational, rolling, signal, spatial

PARTS = (signal, relational, evidence, audio, rolling, spatial, priors, performance, packets, context)
QUERIES = {n: f for part in PARTS for n, f in part.QUERIES.items()}
ORACLES = {n: sql for part in PARTS for n, sql in part.ORACLES.items()}


def plain(rows, columns):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in (r[c] for c in columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    expected = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert columns == sorted(names)
    assert plain([r.asDict() for r in df.collect()], columns) == plain(expected, columns)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["track", "stream", "mean", "highest", "coverage", "band"]
    assert df.count() > 0
