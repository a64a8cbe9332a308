"""Every query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from pagequarry.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return connection


def cell(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(cell(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    got = [tuple(cell(r[c]) for c in columns) for r in frame.collect()]
    assert ordered(got) == ordered(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
