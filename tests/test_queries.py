import duckdb
import pytest

from seriesforge import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    frame, want = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=key)
    assert got == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)
