"""Every query that has an oracle against DuckDB at the smallest scale."""

import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted(repr(tuple(value(r[i]) for i in order)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert _sorted([tuple(r) for r in df.collect()], df.columns) == _sorted(want.fetchall(), want.columns)
