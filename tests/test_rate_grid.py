"""Rates over overlapping lookbacks against plain Python: resets, hot and NULL series, odd widths."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from test_skew import by_series, frame, last_per_instant, samples  # noqa: F401
from tidegauge.operators import series


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plain(samples, lookback, step):
    out = []
    for name, group in by_series(samples).items():
        points = last_per_instant(group)
        gains = [0] + [b - a if b >= a else b for (_, a), (_, b) in zip(points, points[1:])]
        first, last = -(-points[0][0] // step), (points[-1][0] + lookback) // step
        for k in range(first, last + 1):
            inside = [i for i, (ts, _) in enumerate(points) if k * step - lookback < ts <= k * step]
            if len(inside) < 2:
                continue
            increase = sum(gains[i] for i in inside[1:])
            seconds = (points[inside[-1]][0] - points[inside[0]][0]) / 1000
            out.append((name or "", k * step, len(inside), increase, round(increase / seconds, 9)))
    return sorted(out)


@pytest.mark.parametrize(
    "lookback, step, slice_ms",
    [(30_000, 10_000, 3_600_000), (50_000, 20_000, 7_000), (7_000, 21_000, 500), (90_000, 90_000, 1_000), (100, 70, 10**7), (64_000, 64_000, 37)],
)
def test_rate_on_grid(frame, samples, lookback, step, slice_ms):  # noqa: F811
    got = series.rate_on_grid(frame, ["s"], "ts", "v", lookback, step, "id", slice_ms=slice_ms).fillna("", ["s"])
    got = got.selectExpr("s", "step", "samples", "increase", "round(rate, 9) AS rate")
    assert rows(got) == plain(samples, lookback, step)


def test_neighbours_far_apart(spark):
    """Buckets whose neighbours lie in other groups."""
    data = [("a", t * 1000, v) for t, v in ((0, 1), (1, 5), (10_000, 2), (10_003, 9), (99_999, 1), (100_000, 4))]
    df = spark.createDataFrame([(s, t, i, v) for i, (s, t, v) in enumerate(data)], "s string, ts bigint, id bigint, v int")
    got = series.rate_on_grid(df, ["s"], "ts", "v", 5_000, 1_000, "id").selectExpr("s", "step", "samples", "increase", "round(rate, 9) AS rate")
    assert rows(got) == plain([(s, t, i, v) for i, (s, t, v) in enumerate(data)], 5_000, 1_000)


def test_work_does_not_grow_with_the_overlap(spark, frame):  # noqa: F811
    """Samples reach one exchange however many steps see them: what is exploded are buckets' steps."""
    plans = []
    for lookback in (10_000, 10_000_000):
        df = series.rate_on_grid(frame, ["s"], "ts", "v", lookback, 10_000, "id")
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert plans[0].count("Exchange") == plans[1].count("Exchange")


def test_no_samples(frame):  # noqa: F811
    assert series.rate_on_grid(frame.limit(0), ["s"], "ts", "v", 30_000, 10_000, "id").count() == 0
    assert series.rate_on_grid(frame.withColumn("v", frame["v"] + F.lit(None).cast("int")), ["s"], "ts", "v", 30_000, 10_000, "id").count() == 0
