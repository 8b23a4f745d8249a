"""Joins of two tables that grow with the input never send one whole through the driver, however small it looks to the planner."""

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["j4_match_first_round", "j4_match_shape_ids", "j4_carry_meta", "j15_merge_similar_colours", "q8_link_cover", "q8_link_rule"])
def test_no_growing_table_is_broadcast(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan
