"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from tidelake.plans import registry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# what SQL cannot say is checked against brute force in the other test files
WITHOUT_SQL = {"ann_topk", "split_text", "retrieve_context"}
QUERIES = {name: run for name, run in QUERIES.items() if name in registry.QUERIES}


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, small, duck, name):
    problem, _, _ = compare(spark, duck, small, QUERIES[name], SQL.get(name))
    if name == "threshold_alerts" and problem == "no rows":
        return
    assert problem is None


def test_every_query_has_sql_but_the_listed_ones():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL  # those of the training data are tested on their own


def test_entry(spark):
    assert entry.entry(spark).count() == 50


@pytest.mark.parametrize("name", ["equi_joins", "vector_dot_product", "pairwise_dot", "cross_join_single_rows",
                                  "semantic_topk", "semantic_topk_filtered", "retrieve_documents", "subqueries_ctes",
                                  "federated_query", "merge_into", "point_in_time_join", "set_ops"])
def test_no_query_plans_a_cross_product(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = QUERIES["filter_equals"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    plan = QUERIES["project_columns"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
