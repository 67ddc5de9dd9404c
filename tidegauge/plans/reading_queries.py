"""Queries over readings, actions and stored readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import catalogue, readings as ops, series
from .registry import query
from .views import EPOCH, HIGH, LOW, MAXIMUM, MINIMUM

NOW = EPOCH + 10 * 86_400
WEEK = 7 * 86_400


@query("telemetry_compose", "SELECT event_id, value FROM telemetry", "telemetry")
def telemetry_compose(v):
    return ops.compose_telemetry(v.readings()).select("event_id", "value")


@query(
    "telemetry_parse",
    """SELECT event_id, measurement_ts::VARCHAR AS measurement_ts, temperature::VARCHAR AS temperature,
       humidity::VARCHAR AS humidity, sensor FROM readings""",
    "readings",
)
def telemetry_parse(v):
    return ops.parse_telemetry(v.telemetry()).select("event_id", *ops.FIELDS)


@query(
    "typed_readings",
    """SELECT event_id, reading_ts, temperature, sensor,
       CASE WHEN isnan(humidity) THEN -1.0 ELSE humidity END AS humidity,
       isnan(humidity) AS humidity_is_nan
       FROM typed WHERE NOT missing AND temperature IS NOT NULL AND humidity IS NOT NULL
         AND reading_ts IS NOT NULL""",
    "typed",
)
def typed_readings(v):
    typed = ops.type_readings(ops.parse_telemetry(v.raw_telemetry()))
    nan = F.isnan("humidity")
    return typed.filter(F.col("error").isNull()).select(
        "event_id",
        "reading_ts",
        "temperature",
        "sensor",
        F.when(nan, -1.0).otherwise(F.col("humidity")).alias("humidity"),
        nan.alias("humidity_is_nan"),
    )


@query(
    "dead_letters",
    """SELECT event_id, value, CASE WHEN missing THEN 'parse' ELSE 'type' END AS error FROM typed
       WHERE missing OR temperature IS NULL OR humidity IS NULL OR reading_ts IS NULL""",
    "typed",
)
def dead_letters(v):
    typed = ops.type_readings(ops.parse_telemetry(v.raw_telemetry()))
    return ops.route(typed, LOW, HIGH).dead.select("event_id", "value", "error")


_ROUTED = "SELECT event_id, reading_ts, sensor, temperature, humidity FROM readings WHERE temperature {} BETWEEN 0 AND 100"


@query("valid_readings", _ROUTED.format(""), "readings")
def valid_readings(v):
    return v.valid().select("event_id", "reading_ts", "sensor", "temperature", "humidity")


@query("invalid_readings", _ROUTED.format("NOT"), "readings")
def invalid_readings(v):
    return ops.route(v.typed(), LOW, HIGH).invalid.select(
        "event_id", "reading_ts", "sensor", "temperature", "humidity"
    )


def _actions(v):
    return ops.actions(v.valid(), MINIMUM, MAXIMUM)


_ACTION = """CASE WHEN temperature < 10 THEN 'power-on' ELSE 'shutdown' END"""
_ACTING = "temperature BETWEEN 0 AND 100 AND (temperature < 10 OR temperature > 80)"


@query(
    "actuator_actions",
    f"SELECT event_id, reading_ts, sensor, temperature, {_ACTION} AS action FROM readings WHERE {_ACTING}",
    "readings",
)
def actuator_actions(v):
    return _actions(v).select("event_id", "reading_ts", "sensor", "temperature", "action")


def _messages(v):
    """Action texts; an action goes out ``reading_ts`` modulo 900 ms after its second."""
    processed = F.col("reading_ts") * 1000 + F.col("reading_ts") % 900
    return _actions(v).select(
        "event_id", processed.alias("processed_ms"), ops.action_message(processed).alias("value")
    )


@query(
    "action_messages",
    f"""SELECT event_id, 'processed_ts:' || (reading_ts * 1000 + reading_ts % 900)::VARCHAR || ' reading_ts:'
       || reading_ts::VARCHAR || ' actuator_id:actuator-0 sensor:' || sensor || ' action:' || {_ACTION} AS value
       FROM readings WHERE {_ACTING}""",
    "readings",
)
def action_messages(v):
    return _messages(v).select("event_id", "value")


@query(
    "action_parse",
    f"""SELECT event_id, reading_ts * 1000 + reading_ts % 900 AS processed_ts, reading_ts,
       'actuator-0' AS actuator_id, sensor, {_ACTION} AS action FROM readings WHERE {_ACTING}""",
    "readings",
)
def action_parse(v):
    return ops.parse_action(_messages(v)).select(
        "event_id", "processed_ts", "reading_ts", "actuator_id", "sensor", "action"
    )


@query(
    "action_delay",
    f"""SELECT event_id, reading_ts * 1000 + reading_ts % 900 + 250 - reading_ts AS delay_raw,
       reading_ts % 900 + 250 AS delay_ms FROM readings WHERE {_ACTING}""",
    "readings",
)
def action_delay(v):
    parsed = ops.parse_action(_messages(v))
    return ops.action_delay(parsed, F.col("processed_ms") + 250).select(
        "event_id", "delay_raw", "delay_ms"
    )


@query(
    "latency_severity",
    """SELECT event_id, round(value / 20, 4) AS duration, CASE WHEN round(value / 20, 4) > 20 THEN 'error'
       WHEN round(value / 20, 4) > 15 THEN 'warning' ELSE 'info' END AS severity FROM ev""",
    "ev",
)
def latency_severity(v):
    timed = v.ev().select("event_id", (F.col("value") / 20).alias("duration"))
    return ops.with_severity(timed, "duration")


@query(
    "ratio_sample",
    """SELECT event_id, event_type FROM ev
       WHERE CAST(concat('0x', substr(md5(event_id::VARCHAR), 1, 8)) AS BIGINT) % 4 = 0""",
    "ev",
)
def ratio_sample(v):
    return ops.sample_ratio(v.ev(), "event_id", 4).select("event_id", "event_type")


@query(
    "to_topic_json",
    """SELECT 'server-room' AS key, '{"measurement_ts":"' || measurement_ts::VARCHAR || '","temperature":"'
       || temperature::VARCHAR || '","humidity":"' || humidity::VARCHAR || '","sensor":"' || sensor || '"}' AS value
       FROM readings""",
    "readings",
)
def to_topic_json(v):
    return ops.to_topic(ops.parse_telemetry(v.telemetry()))


@query(
    "topic_round_trip",
    """SELECT sensor, count(*) AS records, CAST(sum(temperature) AS BIGINT) AS temperatures,
       CAST(sum(reading_ts) AS BIGINT) AS seconds FROM readings GROUP BY sensor""",
    "readings",
)
def topic_round_trip(v):
    """The analyzer's input: records written by the bridge, read back and typed."""
    records = ops.to_topic(ops.parse_telemetry(v.telemetry()))
    typed = ops.type_readings(ops.from_topic(records))
    return typed.groupBy("sensor").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("temperature").alias("temperatures"),
        F.sum("reading_ts").alias("seconds"),
    )


_RECENT = """SELECT reading_ts, sensorID, temperature, humidity FROM store
             WHERE reading_ts BETWEEN {now} - {span} AND {now} {more}"""


@query(
    "sensor_recent",
    _RECENT.format(now=NOW, span=WEEK, more="AND sensorID = 'sensor-8'"),
    "store",
)
def sensor_recent(v):
    stored = v.store(NOW - WEEK, NOW + 1)
    return ops.recent(stored, NOW, WEEK, "sensor-8")


@query("all_recent", _RECENT.format(now=NOW, span=3600, more=""), "store")
def all_recent(v):
    return ops.recent(v.store(NOW - 3600, NOW + 1), NOW)


@query("sensor_ids", "SELECT DISTINCT sensorID FROM store", "store")
def sensor_ids(v):
    return v.store().select("sensorID").distinct()


@query("default_sensor", "SELECT min(sensorID) AS sensor FROM store", "store")
def default_sensor(v):
    return ops.default_sensor(v.store())


@query(
    "upsert_latest_by_key",
    """SELECT reading_ts, event_id, sensor, temperature FROM (SELECT *, row_number() OVER
       (PARTITION BY reading_ts ORDER BY reading_ts + k DESC, event_id DESC) AS rn FROM readings) WHERE rn = 1""",
    "readings",
)
def upsert_latest_by_key(v):
    rows = v.readings().select(
        "reading_ts",
        (F.col("reading_ts") + F.col("k")).alias("process_ts"),
        "event_id",
        "sensor",
        "temperature",
    )
    latest = catalogue.latest_by_key(rows, ["reading_ts"], ["process_ts", "event_id"])
    return latest.select("reading_ts", "event_id", "sensor", "temperature")


@query(
    "retention_filter",
    f"SELECT event_id, ts, pod_name FROM metrics WHERE ts >= {EPOCH + 25 * 86400} - 15 * 86400",
    "metrics",
)
def retention_filter(v):
    asof, period = EPOCH + 25 * 86_400, 15 * 86_400
    kept = ops.retained(v.metrics(since_s=asof - period), F.col("ts"), asof, period)
    return kept.select("event_id", "ts", "pod_name")


@query("preview", "SELECT event_id, ts, host, value FROM metrics ORDER BY event_id LIMIT 5", "metrics")
def preview(v):
    return series.head(v.metrics().select("event_id", "ts", "host", "value"), ["event_id"], 5)


@query(
    "local_time",
    """SELECT event_id, strftime(timezone('Europe/Stockholm', timezone('UTC', ts)), '%Y-%m-%dT%H:%M:%S')
       AS local_ts FROM events""",
)
def local_time(v):
    return v.table("events").select(
        "event_id", rules.local_iso(F.col("ts").cast("timestamp")).alias("local_ts")
    )


@query(
    "calendar_profile",
    """SELECT event_id, CASE WHEN isodow(ts) > 5 THEN 0 WHEN hour(ts) >= 9 AND hour(ts) < 18 THEN 80
       WHEN (hour(ts) >= 6 AND hour(ts) < 9) OR (hour(ts) >= 18 AND hour(ts) < 21) THEN 15 ELSE 5 END AS requests
       FROM events""",
)
def calendar_profile(v):
    return v.table("events").select(
        "event_id", rules.calendar_requests(F.col("ts")).alias("requests")
    )


@query(
    "round_robin_class",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'tiny' WHEN 1 THEN 'small' ELSE 'large' END AS size_class
       FROM events""",
)
def round_robin_class(v):
    return v.table("events").select(
        "event_id", rules.size_class(F.col("event_id")).alias("size_class")
    )


@query(
    "doc_filter",
    """SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 1000
       AND list_contains(regexp_split_to_array(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+'), 'the')
       AND list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), 'with')""",
)
def doc_filter(v):
    """Title (first line) and content each contain a word, status and lower bound match."""
    title = F.substring_index("text", "\n", 1)
    return (
        v.table("documents")
        .filter((F.col("lang") == "en") & (F.col("n_chars") >= 1000))
        .filter(text.contains_word(title, "the") & text.contains_word(F.col("text"), "with"))
        .select("doc_id", "source", "n_chars")
    )
