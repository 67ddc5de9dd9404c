"""Hot groups: results against plain Python, and no task that gets a whole group.

One series holds most rows, many of them at one instant, and values collide heavily.
"""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import joins, numbering, series


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def samples():
    """(series, ts, id, value): a hot series, a NULL series, repeated instants, negative times."""
    rng = random.Random(7)
    out = []
    for i in range(4000):
        name = "hot" if i % 3 else rng.choice(["a", "b", None])
        ts = 0 if rng.random() < 0.3 else rng.randrange(-20_000, 200_000, 7)
        out.append((name, ts, i, rng.randrange(0, 20)))
    return out


@pytest.fixture(scope="module")
def frame(spark, samples):
    return spark.createDataFrame(samples, "s string, ts bigint, id bigint, v int").repartition(5).cache()


def by_series(samples):
    groups = {}
    for name, ts, i, v in samples:
        groups.setdefault(name, []).append((ts, i, v))
    return groups


def last_per_instant(group):
    last = {}
    for ts, i, v in group:
        if ts not in last or i > last[ts][0]:
            last[ts] = (i, v)
    return sorted((ts, v) for ts, (_, v) in last.items())


@pytest.mark.parametrize("chunk", [1, 8, 64, 1000, 1 << 20])
def test_positions(frame, samples, chunk):
    want = []
    for name, group in by_series(samples).items():
        want += [(i, n) for n, i in enumerate(sorted(i for _, i, _ in group), 1)]
    assert rows(numbering.positions(frame, ["s"], "id", chunk_rows=chunk), "id", "pos") == sorted(want)


def test_sequential_ids(frame, samples):
    got = rows(numbering.sequential_ids(frame, ["v", "id"], "n", start=5), "n", "v", "id")
    ordered = sorted((v, i) for _, _, i, v in samples)
    assert got == [(n, v, i) for n, (v, i) in enumerate(ordered, 5)]


@pytest.mark.parametrize("slice_ms", [500, 7000, 10_000_000])
def test_rate(frame, samples, slice_ms):
    window = 50_000
    want = []
    for name, group in by_series(samples).items():
        windows = {}
        for ts, v in last_per_instant(group):
            windows.setdefault(ts // window, []).append((ts, v))
        for w, points in windows.items():
            if len(points) < 2:
                continue
            increase = sum(b - a if b >= a else b for (_, a), (_, b) in zip(points, points[1:]))
            seconds = (points[-1][0] - points[0][0]) / 1000
            want.append((str(name), w * window, len(points), increase, round(increase / seconds, 9)))
    got = series.rate(frame, ["s"], "ts", "v", window, "id", slice_ms)
    got = got.select(F.coalesce("s", F.lit("None")), "window_start", "samples", "increase", F.round("rate", 9))
    assert rows(got, "*") == sorted(want)


@pytest.mark.parametrize("slice_ms", [3000, 10_000, 10_000_000])
def test_trailing_count(frame, samples, slice_ms):
    span = 3000
    want = []
    for name, group in by_series(samples).items():
        times = [ts for ts, _, _ in group]
        for t in set(times):
            want.append((str(name), t, sum(t - span < x <= t for x in times)))
    got = series.trailing_count(frame, ["s"], "ts", span, slice_ms)
    assert rows(got.select(F.coalesce("s", F.lit("None")), "ts", "n"), "*") == sorted(want)


@pytest.mark.parametrize("span, step", [(3000, 1000), (3000, 7000), (10_000, 10_000)])
def test_trailing_count_on_grid(frame, samples, span, step):
    want = []
    for name, group in by_series(samples).items():
        times = [ts for ts, _, _ in group]
        for t in range(-30_000 // step * step, 230_000, step):
            n = sum(t - span < x <= t for x in times)
            if n:
                want.append((str(name), t, n))
    got = series.trailing_count_on_grid(frame, ["s"], "ts", span, step)
    assert rows(got.select(F.coalesce("s", F.lit("None")), "step", "n"), "*") == sorted(want)


@pytest.mark.parametrize("slice_ms", [200, 5000, 60_000, 10_000_000])
@pytest.mark.parametrize("limit", [2, 12, 19])
def test_sustained(frame, samples, slice_ms, limit):
    hold = 1000
    want = []
    for name, group in by_series(samples).items():
        since = None
        for ts, v in last_per_instant(group):
            if v >= limit:
                since = None
                continue
            since = ts if since is None else since
            want.append((str(name), ts, since, "firing" if ts - since >= hold else "pending"))
    got = series.sustained(frame, ["s"], "ts", F.col("v") < limit, hold, "id", slice_ms)
    got = got.select(F.coalesce("s", F.lit("None")), "ts", "active_since", "state")
    assert rows(got, "*") == sorted(want)


def test_unique_input_skips_the_collapse(frame):
    """Aligned samples give the same results with and without the collapse, with one shuffle less."""
    grid = series.align(frame, ["s"], "ts", "v", 1000, "id").repartition(3).cache()
    below = F.col("v") < 12
    for run in (
        lambda unique: series.rate(grid, ["s"], "step", "v", 50_000, slice_ms=7000, unique=unique),
        lambda unique: series.sustained(grid, ["s"], "step", below, 1000, slice_ms=7000, unique=unique),
    ):
        with_collapse, without = run(False), run(True)
        columns = [F.coalesce("s", F.lit("None")), *[c for c in without.columns if c != "s"]]
        assert rows(without, *columns) == rows(with_collapse, *columns)
        collapse = r"Exchange hashpartitioning\(s#\d+, step#\d+L, \d+\)"
        for df, expected in ((with_collapse, True), (without, False)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert bool(re.search(collapse, plan)) is expected


def test_repeated_instants_are_combined_before_the_shuffle(spark):
    """A million copies of one instant leave the map side as one row per task."""
    hot = spark.range(0, 1_000_000, 1, 8).select(F.lit("hot").alias("s"), F.lit(5).alias("ts"), "id")
    counted = series.trailing_count(hot.withColumn("ts", F.col("ts").cast("bigint")), ["s"], "ts", 1000)
    assert rows(counted, "s", "ts", "n") == [("hot", 5, 1_000_000)]
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_hot_group_is_spread_over_chunks(spark):
    """Positions of a single group: every window partition stays within the chunk size."""
    one = spark.range(100_000).select(F.lit("hot").alias("s"), "id")
    got = numbering.positions(one, ["s"], "id", chunk_rows=1000)
    assert got.filter(F.col("pos") != F.col("id") + 1).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "div 1000" in plan and "SinglePartition" not in plan


@pytest.fixture
def small_skew_limits(spark):
    """No broadcast, and skew limits that fit test data."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_label_join_splits_a_hot_pod(spark, small_skew_limits):
    pod = F.when(F.col("id") % 5 > 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id") % 50))
    samples = spark.range(0, 100_000, 1, 8).select(
        "id", F.lit("n").alias("namespace"), F.lit("h").alias("host"), pod.alias("pod_name")
    )
    info = samples.select("namespace", "host", "pod_name").distinct().withColumn(
        "label_workload_id", F.concat(F.lit("w-"), "pod_name")
    )
    joined = joins.label_join(samples, info)
    assert "skew=true" in final_plan(joined)
    assert joined.count() == 100_000
    assert joined.filter(F.col("label_workload_id") != F.concat(F.lit("w-"), "pod_name")).count() == 0


def test_window_join_splits_a_hot_workload(spark, small_skew_limits):
    samples = spark.range(0, 60_000, 1, 8).select(
        "id",
        F.when(F.col("id") % 5 > 0, F.lit("hot")).otherwise(F.concat(F.lit("w"), F.col("id") % 50)).alias("wl"),
        F.lit("n").alias("ns"),
        (F.col("id") % 5000).alias("ts"),
    )
    workloads = samples.select("wl", "ns").distinct().select(
        "wl", "ns", F.lit(1000).cast("bigint").alias("created_s"), F.lit(2000).alias("duration"),
        F.col("wl").alias("workload"),
    )
    joined = joins.window_join(samples, workloads, "ts", ["wl", "ns"])
    assert "skew=true" in final_plan(joined)
    inside = samples.filter(F.col("ts").between(940, 3060)).count()
    assert joined.count() == inside and joined.filter("wl <> workload").count() == 0


def test_trailing_count_has_no_frame_of_the_span(spark):
    """A running sum, whatever the span: no frame in which each row adds up its span again."""
    hot = spark.range(0, 5000).select(F.lit("hot").alias("s"), F.col("id").alias("ts"))
    counted = series.trailing_count(hot, ["s"], "ts", 4000, 1000)
    assert "RangeFrame" not in counted._jdf.queryExecution().executedPlan().toString()
    assert rows(counted, "ts", "n") == [(t, min(t + 1, 4000)) for t in range(5000)]


def test_positions_of_sparse_ids_are_summed_in_spans(spark):
    """Every row is a chunk of its own; no task gets the chunks of the whole group."""
    ids = spark.range(500).selectExpr("'g' AS s", "(id - 250) * 10007 AS seq")
    got = numbering.positions(ids, ["s"], "seq", chunk_rows=100)
    want = [((i - 250) * 10007, i + 1) for i in range(500)]
    assert rows(got, "seq", "pos") == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(_span#\d+", plan)
