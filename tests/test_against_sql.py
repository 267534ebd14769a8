"""Registered queries against their SQL on tables made for cases that the given ones don't hold."""

import os

import duckdb
import pytest

from casewright import registry

SF = "/root/testdata/sf0.001"


def _both(spark, name, folder):
    got = [tuple(r) for r in registry.QUERIES[name](spark, str(folder)).collect()]
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return sorted(got), sorted(con.execute(registry.ORACLE_SQL[name]).fetchall())


def _tables(folder, **changed):
    for f in os.listdir(SF):
        if f.removesuffix(".parquet") not in changed:
            os.symlink(f"{SF}/{f}", folder / f)
    for name, sql in changed.items():
        duckdb.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")


def test_references_without_semicolon(spark, tmp_path):
    titles = ["A &amp; B &amp;&amp", "&amp;lt; &lt;b&gt; &quot", "it&#x27;s &#x27", "R&D &copy &lt", "plain"]
    _tables(tmp_path, pages=" UNION ALL ".join(f"SELECT {k}::BIGINT AS page_id, 'u' AS url, '<title>{t}</title><p class=\"court\">x</p>' AS html" for k, t in enumerate(titles)))
    got, want = _both(spark, "S10_details", tmp_path)
    assert got == want and got[0][1] == "A & B &&amp" and got[1][1] == '&lt; <b> &quot'


@pytest.mark.parametrize("steps", [5, 6])
def test_chain_ends_where_the_sql_does(spark, tmp_path, steps):
    keys = [1, *range(11, 10 + steps), 1400]  # each cites the one before it
    orders = " UNION ALL ".join(f"SELECT * REPLACE ({k}::BIGINT AS o_orderkey, 1::BIGINT AS o_custkey, TIMESTAMP '2000-01-01' + INTERVAL {n} DAY AS o_orderdate) FROM (SELECT * FROM '{SF}/orders.parquet' LIMIT 1)" for n, k in enumerate(keys))
    _tables(tmp_path, orders=orders, lineitem=f"SELECT * FROM '{SF}/lineitem.parquet' WHERE false")
    got, want = _both(spark, "G4_chain", tmp_path)
    assert got == want and [r[0].count(",") for r in got] == [5] * (steps == 5)
