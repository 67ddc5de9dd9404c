"""Every registered query equals its SQL on the smallest driver tables."""

from __future__ import annotations

import os

import oracle
import pytest

import __spark_entry__ as entry_point

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")

QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, duck, name):
    count, difference = oracle.compare(QUERIES[name](spark, FOLDER), duck, SQL[name])
    assert difference is None
    assert count > 0


def test_flagship_runs(spark):
    assert entry_point.entry(spark).count() > 0


def test_invariants(spark):
    """Every message has exactly one fate; actions come from valid readings only."""
    dead = QUERIES["dead_letters"](spark, FOLDER).count()
    typed = QUERIES["typed_readings"](spark, FOLDER).count()
    events = spark.read.parquet(f"{FOLDER}/events.parquet").count()
    assert dead + typed == events
    valid = QUERIES["valid_readings"](spark, FOLDER)
    actions = QUERIES["actuator_actions"](spark, FOLDER)
    assert actions.join(valid, "event_id", "left_anti").count() == 0
    assert {r.action for r in actions.select("action").distinct().collect()} == {"power-on", "shutdown"}
