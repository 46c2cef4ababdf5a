"""Every query that has SQL must give the rows DuckDB gives for it."""

import math

import duckdb
import pytest

from tessera.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet/*.parquet')" if __import__("os").path.isdir(f"{DATA}/{t}.parquet") else f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    try:
        return round(float(v), 4) + 0.0
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = [r.asDict() for r in df.collect()]
    if name not in ORACLE:
        assert got
        return
    found = duck.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    want = [dict(zip(columns, r, strict=True)) for r in found.fetchall()]
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: sorted((k, repr(norm(v))) for k, v in r.items())
    assert sorted(map(key, got)) == sorted(map(key, want))
