"""Physical plans: pruned scans, no pair-producing joins, no Python where expressions suffice."""

import pytest

from voxlake.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n.startswith(("tx0", "tx12", "tx13", "tx15", "ag16", "st11_event", "jn11")) and n not in ("tx09_word_errors",)])
def test_stays_in_the_jvm(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "Pandas" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_columns_are_pruned(spark):
    text = plan(spark, "ag22_batch_summary")
    assert "ReadSchema: struct<o_orderstatus:string,o_orderpriority:string>" in text


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan(spark, "fl10_failure_classes")


def test_one_large_shuffle_per_scan(spark):
    # The rows move once, on (user, block); the two other exchanges carry block summaries.
    text = plan(spark, "wn14_latest_speaker")
    assert text.count("Exchange hashpartitioning") <= 4 and "_block" in text
