import duckdb
import pytest

import __spark_entry__
from brightloom.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    rel = con.sql(ORACLE_SQL[name])
    columns = rel.columns
    assert sorted(df.columns) == sorted(columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == sorted(map(repr, rel.fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_stream_of_windows_equals_the_batch(spark, sf_dir, tmp_path):
    from brightloom.streaming.events import tumbling_counts

    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = tmp_path / "in"
    batch.write.parquet(str(source))
    stream = tumbling_counts(spark.readStream.schema(batch.schema).parquet(str(source)))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in tumbling_counts(batch).collect()}
