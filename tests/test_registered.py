import re

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
QUERIES = queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    sql = oracle_sql().get(name)
    df = QUERIES[name](spark, SF)
    if sql is None:
        assert df.count() > 0
        return
    wrong, type_notes = compare(df, duck, sql)
    assert wrong is None and type_notes == []


def test_entry(spark):
    assert entry(spark).count() == 25


@pytest.mark.parametrize("name", [
    "space_scorecard", "benchmark_question_matrix", "daily_trends", "grounded_steps", "evidence_bundle", "scores_snapshot"])
def test_plans_have_no_cartesian_product(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython", plan)


def test_scan_reads_what_it_needs(spark):
    plan = QUERIES["trend_users"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan and "PushedFilters: [IsNotNull(ts)]" in plan
