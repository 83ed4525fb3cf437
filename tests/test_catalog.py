"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lectern.plans import catalog
from lectern.plans.fixtures import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(name, spark, duck):
    df = catalog.QUERIES[name](spark, DATA)
    got = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    rel = duck.sql(catalog.ORACLE_SQL[name])
    at = sorted(range(len(rel.columns)), key=rel.columns.__getitem__)
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_subpackage(spark, monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "lectern.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(catalog.QUERIES)


def test_plans_push_down_and_keep_top_k(spark):
    plan = lambda n: catalog.QUERIES[n](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan("vector_topk") and "TakeOrderedAndProject" in plan("missing_works")
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan("vector_topk_filtered")
    assert "html" in plan("page_fields") and "url" not in plan("page_fields")
