"""Every query of the catalogue gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tidemill.plans import catalogue_more  # noqa: F401  registers its queries
from tidemill.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def cell(x):
    if x is None or x != x:
        return "~"
    return f"{x:.6f}" if isinstance(x, float) else str(int(x)) if isinstance(x, bool) else f"{x}.000000" if isinstance(x, int) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    duck.execute(SQL[name])
    names = [d[0] for d in duck.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(map(cell, r)) for r in duck.fetchall())
    assert sorted(tuple(map(cell, r)) for r in got.select(*names).collect()) == want


def test_entry_without_llm(spark, monkeypatch):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    monkeypatch.setattr(e, "HAS_LLM", False)
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(SQL)
