"""Every registered query of the reference's operators against DuckDB on the same tables."""

import os

import duckdb
import pytest

from casewright import registry

SF = os.environ.get("CASEWRIGHT_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(registry.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda p: sorted(map(tuple, p[cols].astype(str).replace({"nan": "None", "<NA>": "None", "NaT": "None"}).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
