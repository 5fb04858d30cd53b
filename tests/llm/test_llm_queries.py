"""The queries that SQL can express, on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from hitweave.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    df = queries.QUERIES[name](spark, str(DATA))
    r = c.execute(queries.SQL[name])
    names = [d[0] for d in r.description]
    want = Counter(tuple(x[names.index(k)] for k in df.columns) for x in r.fetchall())
    assert Counter(map(tuple, df.collect())) == want
