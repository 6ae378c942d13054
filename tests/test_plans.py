"""Plan shape guards: the properties the design relies on at scale."""

import os

import pytest

from guestlens.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def plan_of(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop_anywhere(spark):
    for name in QUERIES:
        p = plan_of(spark, name)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


@pytest.mark.parametrize("name", ["instant_select", "place_search", "improvement_priorities",
                                  "review_display_split", "full_page_cap"])
def test_top_k_is_a_group_limit(spark, name):
    assert "WindowGroupLimit" in plan_of(spark, name)


def test_scans_read_only_what_is_used(spark):
    p = plan_of(spark, "overall_sentiment")
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in p
    assert "p_name" not in p.split("ReadSchema")[-1]


def test_one_mention_scan_and_two_shuffles(spark):
    p = plan_of(spark, "aspect_feedback")
    assert p.count("Exchange hashpartitioning") <= 2 + p.count("SortMergeJoin") * 2 and p.count("events.parquet") == 1
