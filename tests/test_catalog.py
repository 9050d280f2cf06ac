"""Each registered query against its SQL in DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from factspark import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(float(v), 6) if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(columns), sorted(([clean(r[i]) for i in order] for r in data), key=str)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    found = duck.execute(catalog.oracle_sql()[name])
    want = rows([d[0] for d in found.description], found.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
