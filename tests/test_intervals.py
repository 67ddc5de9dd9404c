"""Joins over time and last writes against plain Python: long windows, moving labels, nulls and ties."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tidegauge.operators import catalogue, joins, series


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_cover_of_a_window(spark):
    """Blocks make up the interval exactly, without overlap, and a year is cut into fewer than 30."""
    rng = random.Random(1)
    pairs = [(lo, lo + n) for n in (0, 1, 2, 3, 4, 7, 63, 64, 255, 365, 366, 1000) for lo in (rng.randrange(-500, 500) for _ in range(12))]
    df = spark.createDataFrame(pairs, "low bigint, high bigint")
    for r in df.withColumn("cover", joins._cover(F.col("low"), F.col("high"))).collect():
        days = [d for b in r["cover"] for d in range(b["block"] * 4 ** b["level"], (b["block"] + 1) * 4 ** b["level"])]
        assert sorted(days) == list(range(r["low"], r["high"] + 1))
        if r["high"] - r["low"] <= 366:
            assert len(r["cover"]) < 30
    one = spark.range(1).select(joins._blocks(F.lit(-5)).alias("b")).first()["b"]
    assert [(x["level"], x["block"]) for x in one] == [(0, -5), (1, -2), (2, -1), (3, -1)]


def test_window_join_with_windows_of_all_lengths(spark):
    rng = random.Random(2)
    day = 86_400
    owners = ["hot", "a", None]
    samples = [(i, "hot" if i % 3 else rng.choice(owners), rng.randrange(-30 * day, 500 * day)) for i in range(1500)]
    workloads = [(w, rng.choice(owners), rng.randrange(-40 * day, 400 * day), rng.choice([0, 59, 3600, 2 * day, 40 * day, 400 * day])) for w in range(60)]
    got = joins.window_join(
        spark.createDataFrame(samples, "id bigint, owner string, ts bigint"),
        spark.createDataFrame(workloads, "w bigint, owner string, created_s bigint, duration bigint"),
        "ts",
        ["owner"],
    )
    want = [(i, w) for i, o, t in samples for w, p, c, d in workloads if o is not None and o == p and c - 60 <= t <= c + d + 60]
    assert rows(got, "id", "w") == sorted(want)


@pytest.mark.parametrize("stale, slice_", [(300, 86_400), (50, 1000), (5000, 700)])
def test_label_join_over_time(spark, stale, slice_):
    """Pods that move, show two labels, vanish and come back, across slices and scrape gaps."""
    rng = random.Random(stale)
    shown, samples = set(), []
    for pod in ("p", "q", None):
        at, label = 0, "w0"
        while at < 6000:
            if rng.random() < 0.2:
                label = f"w{rng.randrange(3)}"
            shown |= {(pod, at, label)} | ({(pod, at, "both")} if rng.random() < 0.1 else set())
            at += rng.choice([30, 30, 30, 40, 700])
        samples += [(i, pod, rng.randrange(-100, 7000)) for i in range(300)]
    got = joins.label_join_over_time(
        spark.createDataFrame(samples, "id bigint, pod string, ts bigint"),
        spark.createDataFrame(sorted(shown, key=str) * 2, "pod string, at bigint, wl string"),
        "ts", "at", ["pod"], "wl", stale, slice_,
    )
    want = []
    for i, pod, ts in samples:
        last = max((a for p, a, _ in shown if p == pod and a <= ts), default=None)
        if last is not None and ts < last + stale:
            want += [(i, pod, ts, w) for p, a, w in shown if p == pod and a == last]
    assert rows(got, "id", "pod", "ts", "wl") == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def test_intervals_join_equal_snapshots(spark):
    shown = [("p", t, "a") for t in range(0, 3000, 30)] + [("p", t, "b") for t in range(3000, 6000, 30)]
    got = joins.label_intervals(spark.createDataFrame(shown, "pod string, at bigint, wl string"), "at", ["pod"], "wl")
    assert rows(got, "labels", "since", "until") == [(["a"], 0, 3000), (["b"], 3000, 6270)]


ORDERS = [["t"], ["t", "n"], ["n", "t", "s"], ["s", "n"], ["x"], ["at", "n"]]


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("columns", [["k", "t", "n", "x", "at", "s"], ["k", "t", "n", "x", "at"]])
def test_latest_by_key(spark, order, columns):
    """One whole row per key, the highest by the order, nulls lowest; a third of all rows have one key."""
    if not set(order) <= set(columns):
        pytest.skip("no such column")
    rng = random.Random(5)
    maybe = lambda x: None if rng.random() < 0.1 else x
    data = [
        (maybe("hot" if i % 3 == 0 else f"k{i % 40}"), maybe(rng.randrange(-5, 5)), maybe(rng.choice([-(2**63), -1, 0, 3, 2**63 - 1])),
         maybe(rng.choice([0.5, -2.0, 7.25])), maybe(rng.randrange(4)), maybe(rng.choice("abc")))
        for i in range(2000)
    ]
    df = spark.createDataFrame(data, "k string, t bigint, n bigint, x double, at_s int, s string")
    df = df.withColumn("at", F.timestamp_seconds("at_s")).select(*columns)
    if order[0] == "n":  # the first of two may not be as large as that
        df = df.withColumn("n", F.col("n") % 1000)
    every = [tuple(r) for r in df.collect()]
    at = [columns.index(c) for c in order]
    rank = lambda r: [(r[i] is not None, r[i]) for i in at]
    best = {}
    for r in every:
        if r[0] not in best or rank(r) > rank(best[r[0]]):
            best[r[0]] = r
    got = [tuple(r) for r in catalogue.latest_by_key(df, ["k"], order).collect()]
    assert len(got) == len(best)
    for r in got:
        assert r in every and rank(r) == rank(best[r[0]])


def test_align_and_last_value_with_nulls(spark):
    data = [("a", 5, 1, 1.0), ("a", 5, None, 2.0), ("a", 5, 3, None), ("a", 4, 9, 4.0), (None, 12, 1, 5.0), (None, -3, 1, 6.0)]
    df = spark.createDataFrame(data, "s string, ts bigint, id bigint, v double")
    assert rows(series.align(df, ["s"], "ts", "v", 10, "id")) == [(None, -10, 6.0), (None, 10, 5.0), ("a", 0, None)]
    assert rows(series.last_value(df, ["s"], "ts", "v", "id"), "s", "v") == [(None, 5.0), ("a", 1.0)]


@pytest.mark.parametrize("name", ["align_samples", "last_not_null", "upsert_latest_by_key"])
def test_last_rows_need_no_sort_aggregation(spark, name):
    df = entry_point.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_product_with_a_heavy_inner_index(spark):
    """One inner index holds a third of both matrices: it is cut into blocks, and no block is large."""
    rng = random.Random(9)
    n = 900
    a = [(rng.randrange(60), 7 if x % 3 == 0 else rng.randrange(40), rng.randrange(-5, 6)) for x in range(n)] + [(None, 1, 2), (1, None, 3)]
    b = [(7 if x % 3 == 0 else rng.randrange(40), rng.randrange(60), rng.randrange(-5, 6)) for x in range(n)] + [(None, 1, 2), (1, None, 3)]
    left, right = (spark.createDataFrame(x, "i bigint, j bigint, v bigint") for x in (a, b))
    want = {}
    for i, k, v in a:
        for k2, j, w in b:
            if k is not None and k == k2:
                want[i, j] = want.get((i, j), 0) + v * w
    for heavy in (20, 1 << 16):
        got = joins.matrix_product(left, right, heavy)
        assert {(r.i, r.j): r.v for r in got.collect()} == want
    split = joins.matrix_product(left, right, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "_at_a" in split and "_at_b" in split
    assert joins.matrix_product(left.limit(0), right).count() == 0
