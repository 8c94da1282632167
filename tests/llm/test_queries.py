import duckdb
import pytest

from loomrank.llm import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_against_sql(spark, oracle, name):
    df = Q.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    rel = oracle.execute(Q.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in rel.fetchall()), key=str)


def test_names():
    assert [n.split("_")[0] for n in Q.queries()] == [f"op{i}" for i in range(1, 11)]
