"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from docgrid import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = df.select(*cols).collect()
    if name not in queries.ORACLE:
        assert rows
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want = con.execute(f"select {', '.join(cols)} from ({queries.ORACLE[name]})").fetchall()
    show = lambda rows: sorted(str([round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r]) for r in rows)
    assert show(rows) == show(want)
