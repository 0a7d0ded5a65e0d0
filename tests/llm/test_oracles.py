"""The numbered queries that SQL can express, held against that SQL on a small table."""

import duckdb
import pytest

from supplylens.llm.queries import ORACLES, QUERIES


def plain(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = QUERIES[name](spark, sf_dir)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert plain(got.select(*columns).collect()) == plain(want.select(*columns).fetchall())
