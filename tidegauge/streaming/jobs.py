"""Bridge, analyzer, actuator and log counting as streaming queries.

Each job is the batch operator applied to a streaming frame. The checkpoint keeps the
position: the first start reads from the earliest record, a restart continues. A record that
cannot be read is a dead letter and never ends a query; an error of the source or of a sink
fails the query, which then restarts from its checkpoint.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators import readings, series
from ..schemas import INVALID_TABLE, TOPIC_KEY, VALID_TABLE
from ..sources.writers import Store

LOG = logging.getLogger(__name__)
RecordSink = Callable[[DataFrame, int], None]
BATCH: dict = {"availableNow": True}


def _start(writer: DataStreamWriter, checkpoint: str, trigger: dict) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _bury(letters: DataFrame, dead: RecordSink | None, batch_id: int) -> None:
    """Give dead letters with ``value`` and ``error`` to their sink; without one, log their number."""
    if dead is not None:
        dead(letters.select("value", "error", F.col("error").alias("key")), batch_id)
        return
    lost = letters.count()
    if lost:
        LOG.warning("batch %d: %d dead letters dropped, no sink is set", batch_id, lost)


def bridge(
    src: DataFrame,
    sink: RecordSink,
    checkpoint: str,
    dead: RecordSink | None = None,
    key: str = TOPIC_KEY,
    trigger: dict = BATCH,
) -> StreamingQuery:
    """Device text to keyed JSON records; text that does not parse goes to ``dead``.

    Dead letters have the raw ``value`` and the reason as ``error`` and as the record ``key``. A batch is
    read and parsed once and kept for both outputs.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = readings.parse_telemetry(batch.select("value")).persist()
        try:
            sink(readings.to_topic(parsed, key), batch_id)
            unread = readings.parsed_rows(parsed, False).withColumn("error", F.lit("parse"))
            _bury(unread, dead, batch_id)
        finally:
            parsed.unpersist()

    return _start(src.writeStream.foreachBatch(write), checkpoint, trigger)


@dataclass(frozen=True)
class AnalyzerConfig:
    """Validity range (both ends valid) and strict action thresholds, with usual values."""

    low: float = 0
    high: float = 10
    minimum: float = 2
    maximum: float = 8


def analyzer(
    src: DataFrame,
    store: Store,
    actions: RecordSink,
    checkpoint: str,
    dead: RecordSink | None = None,
    config: AnalyzerConfig = AnalyzerConfig(),
    processed_ms: Callable[[], Column] = lambda: F.unix_millis(F.current_timestamp()),
    trigger: dict = BATCH,
) -> StreamingQuery:
    """JSON records to stored valid and invalid readings, actions and dead letters.

    A batch is typed once and kept for its outputs. Dead letters are as in ``bridge``. Actions go out before the readings are
    stored, and also when nothing is stored.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        now = processed_ms()
        typed = (
            readings.type_readings(readings.from_topic(batch))
            .withColumn("process_ts", F.floor(now / 1000).cast("bigint"))
            .persist()
        )
        try:
            routed = readings.route(typed, config.low, config.high)
            acting = readings.actions(routed.valid, config.minimum, config.maximum)
            actions(acting.select(readings.action_message(now).alias("value")), batch_id)
            store(routed.valid, VALID_TABLE, batch_id)
            store(routed.invalid, INVALID_TABLE, batch_id)
            _bury(routed.dead, dead, batch_id)
        finally:
            typed.unpersist()

    return _start(src.writeStream.foreachBatch(write), checkpoint, trigger)


def actuator(
    src: DataFrame,
    path: str,
    checkpoint: str,
    received_ms: Column | None = None,
    trigger: dict = BATCH,
) -> StreamingQuery:
    """Action messages to end-to-end delays."""
    received = F.unix_millis(F.current_timestamp()) if received_ms is None else received_ms
    delays = readings.action_delay(readings.parse_action(src), received)
    delays = delays.filter(F.col("reading_ts").isNotNull())
    writer = delays.writeStream.format("parquet").option("path", path).outputMode("append")
    return _start(writer, checkpoint, trigger)


def late_after(src: DataFrame, ts: str, delay: str = "72 hours") -> DataFrame:
    """Reject records older than ``delay`` against the newest one seen."""
    return src.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def log_counts(
    src: DataFrame,
    path: str,
    checkpoint: str,
    by: tuple[str, ...] = ("sensor",),
    delay: str = "72 hours",
    trigger: dict = BATCH,
) -> StreamingQuery:
    """Per-minute log counts, written once their minute can no longer change."""
    counted = series.counts(late_after(src, "timestamp", delay), "timestamp", "1 minute", list(by), "status")
    writer = counted.writeStream.format("parquet").option("path", path).outputMode("append")
    return _start(writer, checkpoint, trigger)
