"""Every registered query against its oracle SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from strandloom import oracles
from strandloom import queries as genomics

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    show = lambda v: "" if pd.isna(v) else str(v) if isinstance(v, str | bool) else f"{float(v):.9g}"
    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_oracle(spark, duck, name):
    got, want = genomics.queries()[name](spark, DIR).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_contract(spark):
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries)
    assert __spark_entry__.entry(spark).count() == 192


def test_streams_equal_batches(spark, tmp_path):
    from strandloom.derived import table
    from strandloom.streaming.events import sessions, tumbling

    batch = table(spark, DIR, "events")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for name, f, args in (("t", tumbling, ("1 hour",)), ("s", sessions, ("30 minutes",))):
        q = f(stream, *args, late="1 day").writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        plain = lambda df: {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()}
        want, got = plain(f(batch, *args)), plain(spark.table(name))
        assert got and got <= want and len(got) > 0.9 * len(want)  # the last day waits for the watermark
