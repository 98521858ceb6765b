"""Queries against their SQL twins."""

import duckdb
import pytest

from brightloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rel = con.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(tuple(r[c] for c in rel.columns) for r in df.collect()) == sorted(rel.fetchall())


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
