"""Every query of the driver contract against DuckDB, or for rows where SQL has no say."""

import duckdb
import pytest

import __spark_entry__
from rowloom import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
con = duckdb.connect()
for t in TABLES:
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")


def shown(rows, columns):
    return sorted(repr([None if isinstance(v, float) and v != v else v for v in (r[c] for c in columns)]) for r in rows)


@pytest.mark.parametrize("name", own.queries())
def test_query(spark, name):
    df = own.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = shown(df.collect(), columns)
    sql = own.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert got == shown([dict(zip(names, r, strict=True)) for r in want.fetchall()], columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
