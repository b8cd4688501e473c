"""The queries that SQL can express, on the smallest tables; the others run over them and return a row for each input."""

import os

import duckdb
import pytest

from bytequarry.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name in ORACLE_SQL:
        want = c.execute(ORACLE_SQL[name])
        columns = sorted(d[0] for d in want.description)
        order = [[d[0] for d in want.description].index(x) for x in columns]
        assert sorted(df.columns) == columns
        assert sorted(repr(tuple(r[x] for x in columns)) for r in got) == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())
        return
    assert len(got) == c.execute("select count(*) from documents").fetchone()[0]
