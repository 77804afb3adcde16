"""Queries that SQL can express give DuckDB's rows."""

import duckdb
import pytest

from tesserine.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in cur.description)
    at = [[c[0] for c in cur.description].index(c) for c in columns]
    want = sorted(tuple(r[i] for i in at) for r in cur.fetchall())
    df = QUERIES[name](spark, tiny)
    assert sorted(df.columns) == columns
    assert sorted(tuple(r) for r in df.select(columns).collect()) == want
