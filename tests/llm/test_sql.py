"""Queries of the subpackage against their SQL, on the smallest tables."""

import duckdb
import pytest

from tessella.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    return format(v, ".9g") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    rows, cols = df.collect(), df.columns
    res = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(cols)
    order = [names.index(c) for c in cols]
    assert sorted([plain(v) for v in r] for r in rows) == sorted([plain(r[i]) for i in order] for r in res.fetchall())
