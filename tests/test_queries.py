"""Every query that has SQL gives DuckDB's rows."""

import math

import duckdb
import pytest

from tesserine.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return int(v) if hasattr(v, "as_tuple") else v


def sortable(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, tiny, name):
    df = QUERIES[name](spark, tiny)
    names = sorted(df.columns)
    got = [tuple(plain(r[n]) for n in names) for r in df.select(names).collect()]
    cur = duck.execute(ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == names
    want = [tuple(plain(r[cols.index(n)]) for n in names) for r in cur.fetchall()]
    as_number = lambda rows: sortable([tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in rows])
    assert as_number(got) == as_number(want)
