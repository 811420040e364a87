"""The registered queries against DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from glyphveil.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = ("customer", "documents")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted([tuple("" if v is None or v is pd.NA or v != v else str(v) for v in row) for row in df[cols].itertuples(index=False)])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    want = con.execute(queries.ORACLE[name]).df()
    assert len(got) > 0 and plain(got) == plain(want)


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "redacted"] and df.count() == 200 and df.where("redacted LIKE '%[REDACTED]%'").count() > 0
