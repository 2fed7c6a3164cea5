import math

import duckdb
import pytest

from loomql import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 4) if isinstance(v, float) else v if isinstance(v, (int, str)) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in got.collect())
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_plans(spark):
    """What Catalyst makes of them: filters at the scan, semi joins, top-k."""
    text = lambda n: queries.QUERIES[n](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in text("select_where_limit")
    assert "PushedFilters: [IsNotNull(o_totalprice)" in text("keyset_after")
    assert "LeftAnti" in text("delete_join") or "ExistenceJoin" in text("exists")
    assert "BroadcastNestedLoopJoin" not in text("join_inner")
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text("select_raw_values")
    assert "Exchange" not in text("update_when")


@pytest.mark.parametrize("name", ["where_in_lists", "in_subquery"])
def test_not_in_is_no_nested_loop(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ExistenceJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
