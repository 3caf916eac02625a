"""Plans: what is read, what is shuffled, and that the JVM does the work."""

import pytest

from rolescope.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["tier_counts", "bullet_pick", "tailored_text", "rule_table_score", "plan_report", "change_feed"])
def test_no_cross_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["dedup_first_wins", "tier_counts"])
def test_groups_are_cut_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "WindowGroupLimit" in text and "Partial" in text


def test_text_is_not_read_without_need(spark):
    for name in ("dedup_first_wins", "rescrape_candidates", "artifact_paths"):
        text = plan(spark, name)
        assert "ReadSchema" in text and "text:string" not in text


def test_text_stays_out_of_shuffles(spark):
    # Above the scan's projection the text must not appear in any exchange's output.
    text = plan(spark, "tier_counts")
    above = text[:text.index("FileScan")]
    exchanges = [line for line in above.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("description" in line for line in exchanges)


@pytest.mark.parametrize("name", ["keyword_score", "tier_counts", "excerpt", "segment_lines", "bullet_pick", "llm_parse"])
def test_no_python_in_the_hot_path(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "Arrow" not in text


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(user_id)" in plan(spark, "state_upsert") or "In(event_type" in plan(spark, "state_upsert")
