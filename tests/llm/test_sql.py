"""Queries of the text operators that have SQL, against DuckDB on the smallest tables."""

import glob
import os

import pytest

from pagelode.llm import queries

SF = "/root/testdata/sf0.001"


def norm(v):
    return "nan" if isinstance(v, float) and v != v else repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(k)]) for k in cols) for r in cur.fetchall())
    assert sorted(tuple(norm(r[k]) for k in cols) for r in df.collect()) == want and want
