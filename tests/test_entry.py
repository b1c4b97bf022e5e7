import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the shared tables")
@pytest.mark.parametrize("name", sorted(entry.screening.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got, want = entry.screening.QUERIES[name](spark, SF), con.sql(entry.screening.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda x: sorted(map(repr, x))
    assert rows(map(tuple, got.select(*cols).collect())) == rows(want.select(*[f'"{c}"' for c in cols]).fetchall())
