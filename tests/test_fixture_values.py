"""Totals that were worked out independently for the sf0.01 tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tidegauge.operators import catalogue
from tidegauge.plans.views import Views

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


def total(spark, name, *aggregates, where=None):
    df = entry_point.queries()[name](spark, FOLDER)
    if where is not None:
        df = df.filter(where)
    return tuple(df.agg(*[F.expr(a) for a in aggregates]).first())


N = "count(1)"


@pytest.mark.parametrize(
    "name, aggregates, where, expected",
    [
        ("valid_readings", (N,), None, (8717,)),
        ("invalid_readings", (N,), None, (1283,)),
        ("actuator_actions", (N,), "action = 'power-on'", (1816,)),
        ("actuator_actions", (N,), "action = 'shutdown'", (665,)),
        ("label_join_cpu", (N, "round(sum(value), 2)"), None, (2603, 127099.56)),
        ("logs_per_minute", (N, "sum(total)"), None, (9835, 8018)),
        ("count_over_time", ("sum(n)", "max(n)"), None, (19979, 8)),
        ("counter_rate", (N, "sum(increase)", "round(sum(rate), 5)"), None, (210, 323594, 3.92136)),
        ("alert_sustained", (N, "count(DISTINCT instance)"), "state = 'firing'", (157, 10)),
        ("inject_every_nth", (N, "sum(temperature)"), None, (8717, 391049)),
        ("wl_list_admin", (N,), None, (10000,)),
        ("wl_running", (N,), None, (4979,)),
        ("workload_window_join", (N,), None, (186,)),
        ("telemetry_compose", ("sum(length(value))",), None, (841103,)),
    ],
)
def test_totals(spark, name, aggregates, where, expected):
    assert total(spark, name, *aggregates, where=where) == expected


def test_host_means(spark):
    got = {r.host: r.mean_value for r in entry_point.queries()["host_mean"](spark, FOLDER).collect()}
    assert got == {"worker1": 49.615394, "worker2": 49.466747, "worker3": 49.804684}


def test_latest_by_second(spark):
    rows = Views(spark, FOLDER).readings().select("reading_ts", "event_id")
    latest = catalogue.latest_by_key(rows, ["reading_ts"], ["event_id"])
    assert tuple(latest.agg(F.expr(N), F.sum("event_id")).first()) == (9980, 49893612)
