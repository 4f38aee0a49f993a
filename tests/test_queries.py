"""Every core query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in SF.iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


CORE = [k for k, f in entry.queries().items() if not getattr(f, "__module__", "").startswith("gneiss.llm")]


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(CORE)))
def test_against_sql(spark, db, name):
    df = entry.queries()[name](spark, str(SF))
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    r = db.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert found == rows(cols, r.fetchall())


@pytest.mark.parametrize("name", sorted(set(CORE) - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, str(SF)).count() > 0  # every table here has rows for it


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
