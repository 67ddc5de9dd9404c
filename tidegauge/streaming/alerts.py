"""Sustained-condition alerts on a live stream.

Samples are first aligned to the collection grid by a windowed aggregation: each task combines its part before
the shuffle and the state store keeps one value per series and step. A second one gathers the steps of a series
and time slice, never more than a slice has, and keeps those at which the condition changes. Only these
boundaries reach the state of a series, which is the open run: its start, its last step, and whether it has fired.

A series that goes silent has a timer: when the watermark passes it, the alert resolves and the state goes. A
series without an open run has no state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .jobs import BATCH, _start

EVENT_COLUMNS = ("at_ms", "active_since", "state")


class RunState(StatefulProcessor):
    """Follows the open run of a series over the boundaries of its slices.

    Events: ``pending`` when a run starts, ``firing`` at the moment it has held long enough, if a later step
    of it is seen, and ``resolved`` at the step that ends it, or once nothing was seen for ``silence_ms``.
    """

    def __init__(self, series: Sequence[str], hold_ms: int, silence_ms: int):
        self.columns = [*series, *EVENT_COLUMNS]
        self.hold_ms, self.silence_ms = hold_ms, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "since BIGINT, last BIGINT, fired BOOLEAN")

    def _events(self, key, events: list[tuple]) -> Iterator[pd.DataFrame]:
        if events:
            yield pd.DataFrame([(*key, *e) for e in events], columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slices = []
        for part in rows:  # a row per slice
            slices += zip(part["first_ms"].tolist(), part["last_ms"].tolist(), part["steps"], part["actives"])
        since, last, fired = self.run.get() if self.run.exists() else (None, None, False)
        events: list[tuple] = []
        for first, end, steps, actives in sorted(slices, key=lambda s: s[0]):
            if since is not None and first - last > self.silence_ms:
                events.append((last + self.silence_ms, since, "resolved"))
                since = None
            for step, active in zip(map(int, steps), actives):
                if not active:
                    if since is not None:
                        events.append((step, since, "resolved"))
                    since = None
                    continue
                if since is None:
                    since, fired = step, False
                    events.append((step, since, "pending"))
                if not fired and step - since >= self.hold_ms:
                    fired = True
                    events.append((since + self.hold_ms, since, "firing"))
            last = end
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if since is None:
            self.run.clear()
        else:
            self.run.update((since, last, fired))
            self.handle.registerTimer(last + self.silence_ms)
        yield from self._events(key, events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events = []
        if self.run.exists():
            since, last, _ = self.run.get()
            events.append((last + self.silence_ms, since, "resolved"))
            self.run.clear()
        yield from self._events(key, events)

    def close(self) -> None:
        pass


def aligned_condition(
    samples: DataFrame,
    series: Sequence[str],
    ts: str,
    condition: Column,
    step: str = "10 seconds",
    delay: str = "1 minute",
) -> DataFrame:
    """Condition of the last sample of each series and step: labels, ``step`` (a window), ``active``.

    Labels become text; an absent label equals the empty one.
    """
    labels = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in series]
    return (
        samples.withColumn("_active", F.coalesce(condition, F.lit(False)))
        .withWatermark(ts, delay)
        .groupBy(*labels, F.window(ts, step).alias("step"))
        .agg(F.max_by("_active", F.struct(ts, "_active")).alias("active"))
    )


def boundaries(aligned: DataFrame, series: Sequence[str], slice_: str = "5 minutes") -> DataFrame:
    """The steps of each slice at which a stretch of equal conditions begins or ends.

    Rows of labels, ``ended`` (a time), ``first_ms`` and ``last_ms`` of the slice's steps, and the arrays ``steps`` and
    ``actives``, in order.
    """
    step = F.struct(F.unix_millis("step.start").alias("ms"), "active")
    own = F.window(F.window_time("step"), slice_).alias("_slice")
    gathered = aligned.groupBy(*series, own).agg(F.sort_array(F.collect_list(step)).alias("_all"))
    # Null beyond both ends, which differs from any condition.
    active = lambda i: F.try_element_at(F.col("_all"), i)["active"]
    edge = lambda x, i: ~(
        x["active"].eqNullSafe(F.when(i > 0, active(F.greatest(i, F.lit(1)))))
        & x["active"].eqNullSafe(active(i + 2))
    )
    kept = gathered.withColumn("_kept", F.filter("_all", edge))
    return kept.select(
        *series,
        F.window_time("_slice").alias("ended"),
        F.element_at("_all", 1)["ms"].alias("first_ms"),
        F.element_at("_all", -1)["ms"].alias("last_ms"),
        F.transform("_kept", lambda x: x["ms"]).alias("steps"),
        F.transform("_kept", lambda x: x["active"]).alias("actives"),
    )


def _millis(samples: DataFrame, text: str) -> int:
    row = samples.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {text}) AS ms").first()
    return row["ms"]


def sustained_alerts(
    samples: DataFrame,
    series: Sequence[str],
    ts: str,
    condition: Column,
    hold_ms: int,
    path: str,
    checkpoint: str,
    step: str = "10 seconds",
    delay: str = "1 minute",
    silence: str = "5 minutes",
    slice_: str = "5 minutes",
    trigger: dict = BATCH,
) -> StreamingQuery:
    """Write events of a live condition: labels, ``at_ms``, ``active_since``, ``state`` (see ``RunState``).

    A gap of at most ``silence`` does not end a run; ``slice_`` may not be longer. Events come when their slice is over.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    silence_ms = _millis(samples, silence)
    if _millis(samples, slice_) > silence_ms:
        raise ValueError("a slice longer than the silence that ends a run would hide such a silence")
    aligned = aligned_condition(samples, series, ts, condition, step, delay)
    labels = ", ".join(f"`{c}` STRING" for c in series)
    states = boundaries(aligned, series, slice_).groupBy(*series).transformWithStateInPandas(
        statefulProcessor=RunState(series, hold_ms, silence_ms),
        outputStructType=f"{labels}, at_ms BIGINT, active_since BIGINT, state STRING",
        outputMode="Append",
        timeMode="EventTime",
    )
    writer = states.writeStream.format("parquet").option("path", path).outputMode("append")
    return _start(writer, checkpoint, trigger)
