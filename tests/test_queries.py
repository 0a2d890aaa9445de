"""Every registered query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tessella.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in registry.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else format(v, ".9g")
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows, cols = df.collect(), df.columns
    if name not in SQL:
        return
    res = con.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(cols)
    order = [names.index(c) for c in cols]
    assert sorted([plain(v) for v in r] for r in rows) == sorted([plain(r[i]) for i in order] for r in res.fetchall())
