"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from tidewater.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rel = duck.sql(registry.ORACLES[name])
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    got = sorted(repr(tuple(r[c] for c in columns)) for r in found.collect())
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
