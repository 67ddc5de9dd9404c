"""Metric and log series: alignment, rates, trailing counts, sustained conditions.

A series may be very long and one series may hold a large part of all samples. No operator
here puts a whole series into one window partition. Samples are first collapsed to one per
series and instant (partial aggregation before the shuffle), then cut into time slices. A
(series, slice) has at most as many rows as the slice has milliseconds. What one slice must
know about the slices before it is carried over in one small summary row per slice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules

HOUR_MS = 3_600_000


def _bucket(ts: str, width: int, shift: int = 0) -> Column:
    """Floor of ``(ts + shift) / width`` in integers, also before the epoch."""
    at = f"(`{ts}` + {shift})"
    return F.expr(f"({at} - pmod({at}, {width})) div {width}")


def instants(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    value: str,
    tie: str | None = None,
    unique: bool = False,
) -> DataFrame:
    """One sample per series and instant; of several the one with the highest ``tie`` wins.

    ``max_by`` over fixed-width columns is a hash aggregation with map-side combine, so
    many copies of one instant never travel. ``unique`` says that the input already has one
    sample per instant, as aligned samples do, and saves this shuffle.
    """
    if unique:
        return df.select(*series, ts, value)
    last = F.max_by(value, tie) if tie else F.max(value)
    return df.groupBy(*series, ts).agg(last.alias(value))


def counts(df: DataFrame, ts: str, width: str, by: Sequence[str], column: str) -> DataFrame:
    """Count non-NULL ``column`` per tumbling window of a TIMESTAMP and group.

    Only observed groups appear. Works on batch and on streaming frames.
    """
    return (
        df.groupBy(F.window(ts, width).alias("_window"), *by)
        .agg(F.count(column).alias("total"))
        .select(F.col("_window.start").alias("window_start"), *by, "total")
    )


def align(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    value: str,
    step_ms: int = 10_000,
    tie: str | None = None,
) -> DataFrame:
    """Last sample of each series in each step of the collection grid; ``ts`` and ``tie`` are whole numbers."""
    order = rules.rank(F.col(ts), F.col(tie) if tie else None)
    return (
        df.withColumn("_step", _bucket(ts, step_ms) * step_ms)
        .groupBy(*series, F.col("_step").alias("step"))
        .agg(F.max_by(value, order).alias(value))
    )


def rate(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    value: str,
    window_ms: int,
    tie: str | None = None,
    slice_ms: int = HOUR_MS,
    unique: bool = False,
) -> DataFrame:
    """Counter increase and rate per second of each series in tumbling windows.

    A smaller value than before is a counter reset and counts in full. The rate is the sum
    of increases between the first and the last sample of the window over their distance,
    without extrapolation to the window edges; a window with one sample gives no row.
    ``unique``: see ``instants``.
    """
    present = df.filter(F.col(value).isNotNull())
    samples = instants(present, series, ts, value, tie, unique).withColumns(
        {"_win": _bucket(ts, window_ms), "_slice": _bucket(ts, slice_ms)}
    )

    def increase(now: Column, before: Column) -> Column:
        return F.when(before.isNull(), 0).when(now < before, now).otherwise(now - before)

    in_slice = Window.partitionBy(*series, "_win", "_slice").orderBy(ts)
    steps = samples.withColumn(
        "_inc", increase(F.col(value), F.lag(value).over(in_slice))
    )
    slices = steps.groupBy(*series, "_win", "_slice").agg(
        F.sum("_inc").alias("_inc"),
        F.min(ts).alias("_t0"),
        F.max(ts).alias("_t1"),
        F.min_by(value, ts).alias("_v0"),
        F.max_by(value, ts).alias("_v1"),
        F.count(F.lit(1)).alias("_n"),
    )
    across = Window.partitionBy(*series, "_win").orderBy("_slice")
    edges = slices.withColumn("_edge", increase(F.col("_v0"), F.lag("_v1").over(across)))
    windows = edges.groupBy(*series, "_win").agg(
        F.sum(F.col("_inc") + F.col("_edge")).alias("increase"),
        F.min("_t0").alias("_t0"),
        F.max("_t1").alias("_t1"),
        F.sum("_n").alias("samples"),
    )
    return windows.filter(F.col("_t1") > F.col("_t0")).select(
        *series,
        (F.col("_win") * window_ms).alias("window_start"),
        "samples",
        "increase",
        (F.col("increase") / ((F.col("_t1") - F.col("_t0")) / 1000)).alias("rate"),
    )


def _before(series: Sequence[str], other: str, *more: Column) -> Column:
    """Equality of the series columns with those of a summary, which have ``other`` before their names."""
    same = F.lit(True)
    for c in series:
        same = same & F.col(c).eqNullSafe(F.col(f"{other}{c}"))
    for condition in more:
        same = same & condition
    return same


def _slice_width(bucket_ms: int, slice_ms: int) -> int:
    """A width near ``slice_ms`` that either holds whole buckets or divides them."""
    if bucket_ms <= slice_ms:
        return bucket_ms * (slice_ms // bucket_ms)
    parts = -(-bucket_ms // slice_ms)
    while bucket_ms % parts:
        parts += 1
    return bucket_ms // parts


def rate_on_grid(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    value: str,
    lookback_ms: int,
    step_ms: int,
    tie: str | None = None,
    slice_ms: int = HOUR_MS,
    unique: bool = False,
) -> DataFrame:
    """Counter increase and rate per second in ``(t - lookback, t]`` at every grid step ``t``.

    Resets and the rate are as in ``rate``; a step whose lookback holds fewer than two instants gives
    no row. ``unique``: see ``instants``.

    Increases are summed once along a series, resets put right, so the increase between two samples is the
    difference of two sums. Both ends of a lookback lie on a grid of buckets as wide as the greatest common
    divisor of lookback and step: a step ends with the last sample of its latest bucket and begins with the
    first sample of its earliest one. A bucket knows its neighbours, hence the steps it is that end of, and
    hands its sums to them. A sample is thus read once, however often lookbacks overlap, and what
    is written per step is one row for each end. Sums are made per time slice, with one summary
    row per slice in between, so no series has to fit into one task.
    """
    bucket_ms = math.gcd(lookback_ms, step_ms)
    width = _slice_width(bucket_ms, slice_ms)
    # Buckets and slices are open at their beginning, like the lookback.
    samples = instants(df.filter(F.col(value).isNotNull()), series, ts, value, tie, unique).withColumns(
        {"_slice": _bucket(ts, width, width - 1), "_bucket": _bucket(ts, bucket_ms, bucket_ms - 1)}
    )

    def increase(now: Column, before: Column) -> Column:
        return F.when(before.isNull(), 0).when(now < before, now).otherwise(now - before)

    in_slice = Window.partitionBy(*series, "_slice").orderBy(ts)
    so_far = in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = samples.withColumn("_inc", increase(F.col(value), F.lag(value).over(in_slice))).withColumns(
        {"_sum": F.sum("_inc").over(so_far), "_n": F.row_number().over(in_slice).cast("bigint")}
    )
    # What is summed never falls along a slice, so the ends of a bucket have its extremes.
    pieces = summed.groupBy(*series, "_slice", "_bucket").agg(
        F.min(ts).alias("_t0"), F.max(ts).alias("_t1"),
        F.min("_sum").alias("_sum0"), F.max("_sum").alias("_sum1"),
        F.min("_n").alias("_n0"), F.max("_n").alias("_n1"),
    )
    slices = summed.groupBy(*series, "_slice").agg(
        F.sum("_inc").alias("_inc"),
        F.count(F.lit(1)).alias("_n"),
        F.min_by(value, ts).alias("_v0"),
        F.max_by(value, ts).alias("_v1"),
    )
    along = Window.partitionBy(*series).orderBy("_slice")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    edges = slices.withColumn("_edge", increase(F.col("_v0"), F.lag("_v1").over(along)))
    carried = edges.select(
        *[F.col(c).alias(f"_c_{c}") for c in series],
        F.col("_slice").alias("_c_slice"),
        (F.coalesce(F.sum(F.col("_inc") + F.col("_edge")).over(earlier), F.lit(0)) + F.col("_edge")).alias("_c_sum"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_c_n"),
    )
    buckets = pieces.join(carried, _before(series, "_c_", F.col("_slice") == F.col("_c_slice"))).select(
        *series,
        "_bucket",
        "_t0",
        "_t1",
        *[(F.col(f"_sum{i}") + F.col("_c_sum")).alias(f"_sum{i}") for i in (0, 1)],
        *[(F.col(f"_n{i}") + F.col("_c_n")).alias(f"_n{i}") for i in (0, 1)],
    )
    if width < bucket_ms:
        ends = {"_t0": F.min, "_t1": F.max, "_sum0": F.min, "_sum1": F.max, "_n0": F.min, "_n1": F.max}
        buckets = buckets.groupBy(*series, "_bucket").agg(*[f(c).alias(c) for c, f in ends.items()])
    buckets = _with_neighbours(buckets, series)

    # Steps, counted from 0, that a bucket is the last one of, and those it is the first one of.
    b, reach = F.col("_bucket"), lookback_ms // bucket_ms
    per_step = step_ms // bucket_ms
    up = lambda x: F.ceil(x / per_step)  # noqa: E731  (bucket numbers are far below 2 ** 53)
    down = lambda x: F.floor(x / per_step)
    visible_to = b - 1 + reach
    until = F.least(visible_to, F.coalesce(F.col("_next") - 1, visible_to))
    since = F.greatest(b, F.coalesce(F.col("_previous") + reach, b))
    nothing = lambda name: F.lit(None).cast("bigint").alias(name)

    def steps(first: Column, last: Column) -> Column:
        return F.explode(F.when(up(first) <= down(last), F.sequence(up(first), down(last))))

    sum_type = buckets.schema["_sum0"].dataType
    lasts = buckets.select(
        *series, steps(b, until).alias("_step"), "_t1", "_sum1", "_n1",
        nothing("_t0"), F.lit(None).cast(sum_type).alias("_sum0"), nothing("_n0"),
    )
    firsts = buckets.select(
        *series, steps(since, visible_to).alias("_step"),
        nothing("_t1"), F.lit(None).cast(sum_type).alias("_sum1"), nothing("_n1"), "_t0", "_sum0", "_n0",
    )
    both = lasts.unionByName(firsts).groupBy(*series, "_step").agg(
        *[F.max(c).alias(c) for c in ("_t0", "_t1", "_sum0", "_sum1", "_n0", "_n1")]
    )
    gain = F.col("_sum1") - F.col("_sum0")
    return both.filter(F.col("_t1") > F.col("_t0")).select(
        *series,
        (F.col("_step") * step_ms).alias("step"),
        (F.col("_n1") - F.col("_n0") + 1).alias("samples"),
        gain.alias("increase"),
        (gain / ((F.col("_t1") - F.col("_t0")) / 1000)).alias("rate"),
    )


def _with_neighbours(buckets: DataFrame, series: Sequence[str], together: int = 4096) -> DataFrame:
    """Add ``_previous`` and ``_next``, the nearest buckets of the series that have samples.

    Buckets are looked at in groups of ``together`` numbers; beyond a group's ends its summary helps out.
    """
    grouped = buckets.withColumn("_group", F.floor(F.col("_bucket") / together))
    here = Window.partitionBy(*series, "_group").orderBy("_bucket")
    near = grouped.withColumns(
        {"_previous": F.lag("_bucket").over(here), "_next": F.lead("_bucket").over(here)}
    )
    along = Window.partitionBy(*series).orderBy("_group")
    around = (
        grouped.groupBy(*series, "_group")
        .agg(F.min("_bucket").alias("_low"), F.max("_bucket").alias("_high"))
        .select(
            *[F.col(c).alias(f"_a_{c}") for c in series],
            F.col("_group").alias("_a_group"),
            F.lag("_high").over(along).alias("_a_previous"),
            F.lead("_low").over(along).alias("_a_next"),
        )
    )
    return near.join(around, _before(series, "_a_", F.col("_group") == F.col("_a_group"))).select(
        *buckets.columns,
        *[F.coalesce(f"_{c}", f"_a_{c}").alias(f"_{c}") for c in ("previous", "next")],
    )


def trailing_count(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    span_ms: int,
    slice_ms: int = HOUR_MS,
    name: str = "n",
) -> DataFrame:
    """Events of the series in ``(t - span, t]`` at every instant ``t`` with an event.

    An event adds one at its instant and takes one away a span later; the count is the running sum.
    Each slice is summed by itself and gets the total of the slices before it, so the work does not
    depend on the span and no series has to fit into one task.
    """
    changes = F.explode(
        F.array(
            F.struct(F.col(ts).alias("_at"), F.lit(True).alias("_comes")),
            F.struct((F.col(ts) + F.lit(span_ms)).alias("_at"), F.lit(False).alias("_comes")),
        )
    )
    instants_ = (
        df.filter(F.col(ts).isNotNull())
        .select(*series, changes.alias("_c"))
        .groupBy(*series, F.col("_c._at").alias("_at"))
        .agg(
            F.count(F.when(F.col("_c._comes"), 1)).alias("_come"),
            F.count(F.when(~F.col("_c._comes"), 1)).alias("_go"),
        )
        .withColumns({"_slice": _bucket("_at", slice_ms), "_change": F.col("_come") - F.col("_go")})
    )
    before = Window.partitionBy(*series).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = instants_.groupBy(*series, "_slice").agg(F.sum("_change").alias("_total"))
    carried = totals.select(
        *[F.col(c).alias(f"_{c}") for c in series],
        F.col("_slice").alias("__slice"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry"),
    )
    same = F.col("_slice") == F.col("__slice")
    for c in series:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    within = (
        Window.partitionBy(*series, "_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        instants_.withColumn("_here", F.sum("_change").over(within))
        .filter(F.col("_come") > 0)
        .join(carried, same)
        .select(*series, F.col("_at").alias(ts), (F.col("_here") + F.col("_carry")).alias(name))
    )


def trailing_count_on_grid(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    span_ms: int,
    step_ms: int,
    name: str = "n",
) -> DataFrame:
    """Events in ``(t - span, t]`` at every grid step ``t`` that sees at least one event.

    Events that are visible at the same steps are counted first, then their counts are added to these
    steps: what is repeated per step does not grow with the events.
    """
    first = _bucket(ts, step_ms, step_ms - 1)
    last = _bucket(ts, step_ms, span_ms - 1)
    seen = df.groupBy(*series, first.alias("_first"), last.alias("_last")).agg(
        F.count(F.lit(1)).alias("_events")
    )
    # With a step longer than the span an event may fall between two steps.
    steps = F.when(F.col("_first") <= F.col("_last"), F.sequence("_first", "_last"))
    return (
        seen.withColumn("_step", F.explode(steps))
        .groupBy(*series, (F.col("_step") * step_ms).alias("step"))
        .agg(F.sum("_events").alias(name))
    )


def last_value(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    value: str,
    tie: str | None = None,
    red_from: float = 80,
) -> DataFrame:
    """Last non-NULL value per series with its threshold colour; ``ts`` and ``tie`` are whole numbers."""
    order = rules.rank(F.col(ts), F.col(tie) if tie else None)
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*series)
        .agg(F.max_by(value, order).alias(value))
        .withColumn("colour", rules.colour(F.col(value), red_from))
    )


def sustained(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    condition: Column,
    hold_ms: int,
    tie: str | None = None,
    slice_ms: int = HOUR_MS,
    unique: bool = False,
) -> DataFrame:
    """Samples whose condition holds, with ``active_since`` and ``state``.

    ``firing`` once the condition has held without a false sample for ``hold_ms``, before
    that ``pending``. A missing sample does not end a run, only a false one does.

    Inside a slice a run starts at a true sample after a false one. The first run of a
    slice may continue an earlier one: the per-slice summaries carry the start of the run
    that is open at the end of each slice, and slices that are true throughout pass it on.
    """
    # Both branches below use the same columns, so Spark computes the shuffled slices once.
    tested = df.withColumn("_true", F.coalesce(condition, F.lit(False)))
    samples = instants(tested, series, ts, "_true", tie, unique).select(
        F.struct(
            F.struct(*[F.col(c) for c in series]).alias("series"), _bucket(ts, slice_ms).alias("at")
        ).alias("_key"),
        ts,
        "_true",
    )
    in_slice = Window.partitionBy("_key").orderBy(ts)
    so_far = in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_true = F.col("_true")
    starts = samples.withColumn(
        "_start",
        F.when(is_true & ~F.coalesce(F.lag("_true").over(in_slice), F.lit(False)), F.col(ts)),
    )

    all_true = F.col("_all_true")
    ends = (
        starts.groupBy("_key")
        .agg(
            F.min(ts).alias("_first"),
            F.min("_true").alias("_all_true"),
            F.max("_start").alias("_last_start"),
            F.max(F.when(~is_true, F.col(ts))).alias("_last_false"),
        )
        .withColumns({"_series": F.col("_key.series"), "_at": F.col("_key.at")})
    )
    along = Window.partitionBy("_series").orderBy("_at")
    along_so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Start of the run that is open at the end of a slice with a false sample, if any.
    tail = F.when(~all_true & (F.col("_last_start") > F.col("_last_false")), F.col("_last_start"))
    # A stretch is one slice with a false sample and the all-true slices after it. A slice
    # that is true throughout passes on the open run, or starts one with its first sample.
    stretches = ends.withColumns(
        {"_tail": tail, "_stretch": F.count(F.when(~all_true, 1)).over(along_so_far)}
    )
    stretch = (
        Window.partitionBy("_series", "_stretch")
        .orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inherited = F.coalesce(
        F.max("_tail").over(stretch), F.min(F.when(all_true, F.col("_first"))).over(stretch)
    )
    carried = stretches.withColumn(
        "_open", F.when(all_true, inherited).otherwise(F.col("_tail"))
    ).select("_key", F.lag("_open").over(along).alias("_carried"))

    local = starts.withColumns(
        {
            "_since": F.last("_start", ignorenulls=True).over(so_far),
            "_false_before": F.max(~is_true).over(so_far),
        }
    ).filter(is_true)
    since = F.when(
        F.col("_false_before"), F.col("_since")
    ).otherwise(F.coalesce(F.col("_carried"), F.col("_since")))
    return (
        local.join(carried, "_key")
        .select(
            *[F.col(f"_key.series.{c}").alias(c) for c in series], ts, since.alias("active_since")
        )
        .withColumn(
            "state",
            F.when(F.col(ts) - F.col("active_since") >= hold_ms, F.lit("firing")).otherwise(
                F.lit("pending")
            ),
        )
    )


def newest(
    df: DataFrame,
    ts: str,
    limit: int = 5000,
    tie: Sequence[str] = (),
    bucket_ms: int = HOUR_MS,
) -> DataFrame:
    """Newest-first listing of at most ``limit`` rows (the log store's answer limit).

    A plain top-k sends up to ``limit`` rows of every scan task to one reducer. Counting
    rows per hour first gives the time that certainly holds enough of them; only rows from
    there on are scanned and sorted. The cut-off is one number.
    """
    at = _bucket(ts, bucket_ms)
    seen = Window.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    enough = (
        df.groupBy(at.alias("_at"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_seen", F.sum("_rows").over(seen))
        .filter(F.col("_seen") >= limit)
        .agg(F.max("_at"))
        .first()[0]
    )
    rows = df if enough is None else df.filter(F.col(ts) >= enough * bucket_ms)
    return rows.orderBy(F.desc(ts), *[F.desc(c) for c in tie]).limit(limit)


def head(df: DataFrame, order: Sequence[Column | str], n: int = 5) -> DataFrame:
    """First ``n`` rows in an order, for a look at the data."""
    return df.orderBy(*order).limit(n)


def mean_by(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(f"mean_{value}"))


def series_counts(df: DataFrame, by: str) -> DataFrame:
    """Records per series, and in total under the name ``total``."""
    each = df.groupBy(F.col(by).alias("series")).agg(F.count(F.lit(1)).alias("records"))
    return each.unionByName(
        each.agg(F.sum("records").alias("records")).withColumn("series", F.lit("total"))
    )


def label_values(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Distinct non-NULL values of several labels in one scan."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("label"), F.col(n).cast("string").alias("value")) for n in labels]
    )
    return (
        df.select(F.explode(pairs).alias("_pair"))
        .select("_pair.label", "_pair.value")
        .filter(F.col("value").isNotNull())
        .distinct()
    )


def rate_two_way(
    df: DataFrame, series: Sequence[str], ts: str, sent: Column, received: Column, window_ms: int, tie: str | None = None
) -> DataFrame:
    """Rates of two counters of the same samples, the received one below zero.

    The direction is part of the series key, so the samples are scanned and shuffled once.
    """
    counters = [
        F.struct(F.lit(name).alias("direction"), column.alias("_bytes"))
        for name, column in (("tx", sent), ("rx", received))
    ]
    both = df.withColumn("_counter", F.explode(F.array(*counters))).select("*", "_counter.*")
    rates = rate(both, [*series, "direction"], ts, "_bytes", window_ms, tie)
    sign = F.when(F.col("direction") == "rx", -1.0).otherwise(1.0)
    return rates.withColumn("rate", F.col("rate") * sign)


def two_way(sent: DataFrame, received: DataFrame) -> DataFrame:
    """Sent rates above and received rates below zero."""
    return sent.withColumn("direction", F.lit("tx")).unionByName(
        received.withColumn("direction", F.lit("rx")).withColumn("rate", -F.col("rate"))
    )


def label_experiments(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Rows of the experiments that share one table, in one scan: ``names`` maps name to value of ``column``."""
    name = F.lit(None).cast("string")
    for experiment, value in names.items():
        name = F.when(F.col(column) == value, F.lit(experiment)).otherwise(name)
    return df.filter(F.col(column).isin(list(names.values()))).withColumn("experiment", name)


def combine_experiments(frames: dict[str, DataFrame]) -> DataFrame:
    """Stack the result files of several experiments with an ``experiment`` column."""
    labelled = [df.withColumn("experiment", F.lit(name)) for name, df in frames.items()]
    combined = labelled[0]
    for df in labelled[1:]:
        combined = combined.unionByName(df)
    return combined
