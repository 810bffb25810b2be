"""Every named query against its SQL on the smallest driver tables."""

import pytest
from compare import connect, differences, duck_rows, spark_rows

import __spark_entry__ as entry
from paroxys.catalog import QUERIES as CATALOG
from paroxys.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"
QUERIES = CATALOG
FITTED = {
    "random_forest_loso",
    "gbt_loso",
    "leafwise_gbt_loso",
    "linear_svc_loso",
    "rbf_svc_loso",
    "loso_leaderboard",
    "param_search",
}
RUN_WHEN_BUILT = FITTED | {"gbt_first_tree"} | {n for n in QUERIES if n.startswith("stream_")}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLES) == FITTED


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = spark_rows(QUERIES[name](spark, SF_DIR))
    assert got[1], "no rows"
    assert not differences(got, duck_rows(duck, ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUN_WHEN_BUILT))
def test_plan_has_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan


def test_entry_is_stable(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "user_id" and df.count() > 0


def test_column_pruning_reaches_the_scan(spark):
    plan = QUERIES["segment_metrics"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in plan
