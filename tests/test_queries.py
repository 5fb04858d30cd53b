"""Every query of the core against its SQL, on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from hitweave.plans import files, hits, problems, tasks

DATA = Path("/root/testdata/sf0.001")
PARTS = (hits, problems, files, tasks)
QUERIES = {k: f for p in PARTS for k, f in p.QUERIES.items()}
SQL = {k: q for p in PARTS for k, q in p.SQL.items()}
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    r = db.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert Counter(tuple(plain(x[c]) for c in cols) for x in df.collect()) == want


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(SQL) == {"s_sample_n", "p4_reasons", "x_collapse"}


def test_entry_loads_without_a_session():
    import subprocess
    import sys

    root = Path(__file__).parent.parent
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=root).returncode == 0
