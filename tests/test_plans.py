"""Plan shape of the main queries: scans, shuffles and code generation."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as entry_point
from tidegauge.plans.all_queries import REGISTRY

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


def plan(spark, name):
    df = entry_point.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


NARROW = [
    "telemetry_compose", "telemetry_parse", "typed_readings", "dead_letters", "valid_readings",
    "invalid_readings", "actuator_actions", "action_messages", "action_parse", "action_delay",
    "latency_severity", "ratio_sample", "to_topic_json", "metric_series", "pod_list_series",
    "time_range_exclusive", "label_match", "field_allowlist", "retention_filter", "gen_ints",
    "gen_floats", "gen_readings", "gen_fanout", "ready_nodes", "wl_expired", "doc_filter",
]


@pytest.mark.parametrize("name", NARROW)
def test_no_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


def test_no_python_and_no_cross_join_anywhere(spark):
    for name in REGISTRY:
        text = plan(spark, name)
        for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "InPandas"):
            assert unwanted not in text, (name, unwanted)


@pytest.mark.parametrize("name", ["sensor_recent", "all_recent", "retention_filter", "time_range_exclusive"])
def test_time_ranges_reach_the_scan(spark, name):
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", plan(spark, name))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "doc_filter")
    assert "EqualTo(lang,en)" in text and "GreaterThanOrEqual(n_cha" in text
    # Sensor ids need the user and the validity check, nothing else.
    assert "ReadSchema: struct<user_id:bigint,value:double>" in plan(spark, "sensor_ids")


@pytest.mark.parametrize("name", ["logs_per_minute", "host_mean", "sensor_ids", "upsert_latest_by_key", "last_not_null"])
def test_partial_aggregation_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert len(re.findall(r"(?:Hash|Sort|ObjectHash)Aggregate\(", text)) >= 2


def test_flagship_is_one_generated_stage(spark):
    df = entry_point.entry(spark)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"\*\((\d+)\)", text))) == 1


def test_one_task_only_sees_summaries(spark):
    """Whatever goes to a single task was aggregated in the stage before: totals of a whole
    table and the row counts of sorted partitions."""
    for name in REGISTRY:
        lines = plan(spark, name).splitlines()
        for above, below in zip(lines, lines[1:]):
            if "Exchange SinglePartition" in above:
                assert "Aggregate(" in below, (name, below)
