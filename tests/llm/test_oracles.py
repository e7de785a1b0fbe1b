"""Queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from tidemill.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cur = con.execute(registry.ORACLES[name])
    names = sorted(d[0] for d in cur.description)
    order = [[d[0] for d in cur.description].index(n) for n in names]
    want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)
    df = registry.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == names
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == want and want


def test_every_query_is_registered():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 14)}
