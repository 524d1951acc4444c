"""Queries of the subpackage over the smallest tables, held against their SQL, and their standing in the registry."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import __spark_entry__ as entry  # noqa: E402

from trellis.llm import queries as Q  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are not here")


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    df = Q.QUERIES[name](spark, DATA)
    got = sorted(tuple(map(str, (r[c] for c in sorted(df.columns)))) for r in df.collect())
    if name not in Q.SQL:
        assert got
        return
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    out = con.execute(Q.SQL[name])
    cols = [x[0] for x in out.description]
    want = sorted(tuple(str(dict(zip(cols, r))[c]) for c in sorted(cols)) for r in out.fetchall())
    assert sorted(cols) == sorted(df.columns) and got == want


def test_registry():
    assert set(Q.QUERIES) <= set(entry.queries()) and set(Q.SQL) <= set(Q.QUERIES)
    assert [f"p{n}_found" for n in (5, 6, 7, 8, 9, 10)] == [n for n in Q.QUERIES if n.endswith("_found")]


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2] / "trellis"
    others = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not [p for p in others if "trellis.llm" in p.read_text()]
