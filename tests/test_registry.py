"""Every registered query runs over the smallest tables, with the columns of its SQL; oracles are not vacuous."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

DATA = "/root/testdata/sf0.001"
CORE = sorted(entry.core.QUERIES)
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are not here")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def _plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def same(df, con, sql):
    names = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
    out = con.execute(sql)
    cols = [x[0] for x in out.description]
    want = sorted(tuple(_plain(dict(zip(cols, r))[c]) for c in names) for r in out.fetchall())
    assert sorted(cols) == names
    return got == want


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    df = entry.core.QUERIES[name](spark, DATA)
    if name in entry.core.SQL:
        assert same(df, con, entry.core.SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
