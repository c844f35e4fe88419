"""What grows with the names and questions is not broadcast, however small its files are."""

import pytest

import __spark_entry__ as entry
from tallyspark.llm.leaderboard import settings

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["entity_resolution", "entity_ids", "fuzzy_names"])
def test_names_do_not_go_through_the_driver(spark, name):
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "1g", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1g"}):
        found = entry.queries()[name](spark, SMALL)
        assert len(found.collect()) > 0
        plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
