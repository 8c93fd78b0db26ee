"""The operators' queries against their SQL."""

import duckdb
import pytest

from tidewater.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rel = con.sql(queries.ORACLES[name])
    at = [rel.columns.index(c) for c in columns]
    got = sorted(repr(tuple(r[c] for c in columns)) for r in found.collect())
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
