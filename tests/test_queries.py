"""Every query that has SQL is held against DuckDB on the smallest tables; the others must run."""

import os
import random

import duckdb
import pytest

from bytequarry.operators import tournament
from bytequarry.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLE_SQL:
        return
    want = oracle.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    rows = lambda x: sorted(map(repr, x))
    assert rows(tuple(r[c] for c in order) for r in got) == rows(tuple(r[columns.index(c)] for c in order) for r in want.fetchall())


def test_tournament_sizes_of_all_lengths(spark, tmp_path):
    line = "2026-01-01 INFO user=alice action=login ok "
    rnd = random.Random(6)
    mixed = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    long = ("".join(chr(33 + i % 90) * (i % 7 + 1) for i in range(300)) * 900)[: tournament.BWT_MOST + 1]
    texts = [None, "", "short", line * 23, mixed(999), mixed(1029), mixed(1030), line * 60, mixed(3000), mixed(3001), line * 200, "é" * 4000, mixed(9000), long]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100, mixed(200)), (101, line * 40)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["id"]: (r["n_bytes"], r["method"], r["size"]) for r in QUERIES["tournament_sizes"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [*range(len(texts)), 100, 101] and got.pop(0) == (None, None, None)
    for i, text in enumerate(texts):
        if text is None:
            continue
        data = text.encode()
        method, coded = tournament.best(data)
        assert got[i] == (len(data), method, len(coded))
        if len(data) < 10000:  # all methods, with none left out by a bound
            full = [(len(c), k) for k, m in enumerate(tournament.METHODS[:5]) for c in [tournament.encode(m, data)] if tournament.verified(m, data, c)]
            assert (len(coded), tournament.METHODS.index(method)) == min(full)
    assert len({m for _, m, _ in got.values()}) > 1


def test_nothing_else_imports_the_training_data_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "bytequarry")):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert "llm" not in f.read(), n
