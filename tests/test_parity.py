"""Every query with SQL gives DuckDB's rows on the smallest tables; every other one runs."""

import os

import duckdb
import pytest

from twintext.plans import queries as first
from twintext.plans import project_queries, sql, unit_queries

SF = "/root/testdata/sf0.001"
queries = lambda: first.queries() | unit_queries.queries() | project_queries.queries()
oracle_sql = lambda: sql.oracle_sql() | unit_queries.oracle_sql() | project_queries.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in oracle_sql():
        rel = con.sql(oracle_sql()[name])
        assert sorted(rel.columns) == columns
        assert got == sorted((tuple(norm(dict(zip(rel.columns, r, strict=True))[c]) for c in columns) for r in rel.fetchall()), key=repr)


def test_no_cartesian_product_in_matching(spark):
    for name in ("exact_match", "propagation", "fuzzy_match"):
        plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
