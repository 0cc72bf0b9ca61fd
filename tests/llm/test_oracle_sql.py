"""The SQL of the training-data operators against their queries on the smallest tables."""

import duckdb
import pytest

from strandloom.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_oracle(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = queries.queries()[name](spark, small)
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=str)
    assert sorted((tuple(r) for r in got.select(*sorted(names)).collect()), key=str) == want
