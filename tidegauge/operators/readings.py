"""From raw device text to typed, routed readings and actuator actions.

Every step here is a narrow projection or filter: one scan, no shuffle.
"""

from __future__ import annotations

from datetime import UTC, datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from ..schemas import ACTUATOR_ID, TOPIC_KEY, TOPIC_VALUE

FIELDS = ("measurement_ts", "temperature", "humidity", "sensor")


def _computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns that are computed exactly once per row.

    A filter over a plain projection is pushed below it together with a copy of the
    expressions, so parsing would run for each test of the filter and again for the output.
    A generator over one element is a barrier for that and stays inside code generation.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


def compose_telemetry(df: DataFrame, raw: str = "value") -> DataFrame:
    """Add the device text of a reading. The sensor id is not quoted, so this is not JSON."""
    message = F.concat(
        F.lit('{"measurement_ts":'),
        F.col("measurement_ts").cast("string"),
        F.lit(',"temperature":'),
        F.col("temperature").cast("string"),
        F.lit(',"humidity":'),
        F.col("humidity").cast("string"),
        F.lit(',"sensor":'),
        F.col("sensor"),
        F.lit("}"),
    )
    return df.withColumn(raw, message)


def _positional(raw: str) -> dict[str, Column]:
    values = {
        name: text.second_part(F.try_element_at(F.col("_parts"), F.lit(position)))
        for position, name in enumerate(FIELDS, start=1)
    }
    values["sensor"] = text.drop_last(values["sensor"], 1)
    return values


def _by_name(raw: str) -> dict[str, Column]:
    def after(label: str, pattern: str) -> Column:
        found = F.regexp_substr(F.col(raw), F.lit(label + pattern))
        return F.substring(found, F.lit(len(label) + 1), F.length(found))

    values = {name: after(f'"{name}":', "[^,]*") for name in FIELDS[:3]}
    values["sensor"] = text.drop_last(F.rtrim(after('"sensor":', r".*\}\s*$")), 1)
    return values


_PARSERS = {"positional": _positional, "regex": _by_name}


def parse_telemetry(df: DataFrame, raw: str = "value", mode: str = "positional") -> DataFrame:
    """Split device text into four text fields; a field that is not there is NULL.

    ``positional`` takes the text between the first two colons of each comma part and
    cuts one character off the sensor. ``regex`` keeps sensor ids that contain a colon.
    """
    kept = [F.col(c) for c in df.columns if c not in FIELDS]
    # The comma parts are a column of their own, so the text is split once for four fields.
    parts = df.withColumn("_parts", F.split(raw, ","))
    fields = _PARSERS[mode](raw)
    return parts.select(*kept, *[value.alias(name) for name, value in fields.items()])


def type_readings(df: DataFrame) -> DataFrame:
    """Type the four text fields and add ``error``: NULL, ``parse`` or ``type``."""
    temperature = text.to_int(F.col("temperature"))
    humidity = text.to_double(F.col("humidity"))
    reading_ts = text.millis_text_to_seconds(F.col("measurement_ts"))
    missing = F.greatest(*[F.col(name).isNull() for name in FIELDS])
    untyped = temperature.isNull() | humidity.isNull() | reading_ts.isNull()
    return _computed_once(
        df,
        {
            "error": F.when(missing, F.lit("parse")).when(untyped, F.lit("type")),
            "reading_ts": reading_ts,
            "temperature": temperature,
            "humidity": humidity,
        },
    ).withColumn("event_time", F.timestamp_seconds("reading_ts"))


def with_route(df: DataFrame, low: float, high: float) -> DataFrame:
    """Add ``route``: ``valid``, ``invalid`` or ``dead``. Every row gets exactly one."""
    return df.withColumn(
        "route",
        F.when(F.col("error").isNotNull(), F.lit("dead"))
        .when(rules.in_range(F.col("temperature"), low, high), F.lit("valid"))
        .otherwise(F.lit("invalid")),
    )


class Routed(NamedTuple):
    valid: DataFrame
    invalid: DataFrame
    dead: DataFrame


def route(df: DataFrame, low: float, high: float) -> Routed:
    """Split typed readings three ways."""
    routed = with_route(df, low, high)
    return Routed(*[routed.filter(F.col("route") == name) for name in Routed._fields])


def actions(df: DataFrame, minimum: float, maximum: float) -> DataFrame:
    """Valid readings that call for an action, with ``action``."""
    return df.withColumn(
        "action", rules.actuator_action(F.col("temperature"), minimum, maximum)
    ).filter(F.col("action").isNotNull())


def action_message(processed_ms: Column, actuator_id: str = ACTUATOR_ID) -> Column:
    """Action as the text an actuator receives."""
    return F.concat_ws(
        " ",
        F.concat(F.lit("processed_ts:"), processed_ms.cast("string")),
        F.concat(F.lit("reading_ts:"), F.col("reading_ts").cast("string")),
        F.lit(f"actuator_id:{actuator_id}"),
        F.concat(F.lit("sensor:"), F.col("sensor")),
        F.concat(F.lit("action:"), F.col("action")),
    )


def parse_action(df: DataFrame, raw: str = "value") -> DataFrame:
    """Fields of an action message; NULL where the text has none."""
    words = F.trim(F.col(raw))
    return df.withColumns(
        {
            "processed_ts": text.to_bigint(text.field_after_colon(words, r"\s+", 1)),
            "reading_ts": text.to_bigint(text.field_after_colon(words, r"\s+", 2)),
            "actuator_id": text.field_after_colon(words, r"\s+", 3),
            "sensor": text.field_after_colon(words, r"\s+", 4),
            "action": text.field_after_colon(words, r"\s+", 5),
        }
    )


def action_delay(df: DataFrame, received_ms: Column) -> DataFrame:
    """End-to-end delay of parsed actions.

    ``delay_raw`` subtracts the reading time in seconds from a time in milliseconds, as
    deployed actuators report it; ``delay_ms`` uses one unit.
    """
    return df.withColumns(
        {
            "delay_raw": received_ms - F.col("reading_ts"),
            "delay_ms": received_ms - F.col("reading_ts") * 1000,
        }
    )


def parsed_rows(df: DataFrame, parsed: bool = True) -> DataFrame:
    """Rows in which all four fields were found, or the others."""
    found = ~F.greatest(*[F.col(name).isNull() for name in FIELDS])
    flagged = _computed_once(df, {"_found": found})
    return flagged.filter(F.col("_found") == parsed).drop("_found")


def to_topic(df: DataFrame, key: str = TOPIC_KEY) -> DataFrame:
    """Parsed text fields as a keyed JSON record; unparsed rows are left out."""
    return parsed_rows(df).select(
        F.lit(key).alias("key"), F.to_json(F.struct(*[F.col(n) for n in FIELDS])).alias("value")
    )


def from_topic(df: DataFrame, value: str = "value") -> DataFrame:
    """Four text fields of a JSON topic record; a damaged record gives four NULLs."""
    kept = [F.col(c) for c in df.columns if c not in FIELDS]
    record = F.from_json(F.col(value), TOPIC_VALUE).alias("_record")
    return df.select(*kept, record).select(*kept, "_record.*")


def with_severity(df: DataFrame, duration: str, warn: float = 15, error: float = 20) -> DataFrame:
    """Round a processing time to four digits and grade it."""
    return df.withColumn(duration, F.round(F.col(duration), 4)).withColumn(
        "severity", rules.severity(F.col(duration), warn, error)
    )


def sample_ratio(df: DataFrame, key: str, n: int) -> DataFrame:
    """Keep one of ``n`` traces; this is the sampling operator, not a shortcut."""
    return df.filter(rules.in_ratio_sample(F.col(key), n))


def recent(
    stored: DataFrame, now: int, range_s: int = 3600, sensor: str | None = None
) -> DataFrame:
    """Stored readings of ``[now - range_s, now]``, newest first.

    ``readingTS`` is stored as text, hence the cast before comparing. Tables that also keep the second as
    ``reading_s`` and are partitioned by ``day``, as the relational store's are, are pruned by both.
    """
    at = F.col("readingTS").try_cast("bigint")
    if "reading_s" in stored.columns:
        at = F.col("reading_s")
    rows = stored.filter(at.between(now - range_s, now))
    if "day" in stored.columns:
        days = [datetime.fromtimestamp(s, UTC).date() for s in (now - range_s, now)]
        rows = rows.filter(F.col("day").between(*days))
    if sensor is not None:
        rows = rows.filter(F.col("sensorID") == sensor)
    return rows.select(at.alias("reading_ts"), "sensorID", "temperature", "humidity").orderBy(
        F.desc("reading_ts")
    )


def default_sensor(stored: DataFrame) -> DataFrame:
    """The sensor a display starts with: the first one by name."""
    return stored.agg(F.min("sensorID").alias("sensor"))


def retained(df: DataFrame, ts: Column, asof: int, period: int) -> DataFrame:
    """Rows not older than ``period`` at ``asof`` (same unit as ``ts``)."""
    return df.filter(ts >= asof - period)
