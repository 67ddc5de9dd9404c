"""Queries for numbering, substitution, matrix product and generated tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generate, joins, numbering
from .registry import query
from .views import EPOCH

NORMAL = generate.ValueRange(0.0, 9.99)
ABNORMAL = generate.ValueRange(11.0, 44.99)
DELAYS_MS = (500, 1500, 250, 1000, 750, 2000, 100, 900, 300, 1200)


def _draw(seed: str, key: str) -> str:
    """SQL of the uniform draw in [0, 1)."""
    return f"(CAST(concat('0x', substr(md5('{seed}:' || {key}::VARCHAR), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def _draw_int(key: str, low: int, high: int, seed: str) -> str:
    return f"CAST(floor({_draw(seed, key)} * {high - low}) + {low} AS INTEGER)"


def _draw_float(key: str, low: float, high: float, seed: str) -> str:
    return f"round({_draw(seed, key)} * ({high}::DOUBLE - {low}::DOUBLE) + {low}::DOUBLE, 6)"


@query("gen_ints", f"SELECT event_id, {_draw_int('event_id', 0, 10, 's1')} AS value FROM events")
def gen_ints(v):
    value = generate.uniform_int(F.col("event_id"), NORMAL.low, NORMAL.high, "s1")
    return v.table("events").select("event_id", value.alias("value"))


@query("gen_floats", f"SELECT event_id, {_draw_float('event_id', 11.0, 44.99, 's2')} AS value FROM events")
def gen_floats(v):
    value = generate.uniform_float(F.col("event_id"), ABNORMAL.low, ABNORMAL.high, "s2")
    return v.table("events").select("event_id", F.round(value, 6).alias("value"))


_VALUES = f"""SELECT event_id AS row_id, 'normal' AS class, {_draw_int('event_id', 0, 10, 's3:normal:t')} AS temperature,
    {_draw_float('event_id', 0.0, 9.99, 's3:normal:h')} AS humidity FROM events
  UNION ALL SELECT c_custkey, 'abnormal', {_draw_int('c_custkey', 11, 45, 's3:abnormal:t')},
    {_draw_float('c_custkey', 11.0, 44.99, 's3:abnormal:h')} FROM customer"""


def _values(v, kind):
    normal = v.table("events").select(F.col("event_id").alias("id"))
    abnormal = v.table("customer").select(F.col("c_custkey").alias("id"))
    return generate.value_table(normal, abnormal, "id", NORMAL, ABNORMAL, "s3", kind)


@query("gen_readings", _VALUES)
def gen_readings(v):
    """One normal row per event, one abnormal row per customer."""
    return _values(v, "both").withColumn("humidity", F.round("humidity", 6))


@query(
    "gen_fanout",
    f"""SELECT 'pod-' || n::VARCHAR AS sensor, row_id, temperature, humidity FROM ({_VALUES}), range(3) r(n)
        WHERE class = 'normal'""",
)
def gen_fanout(v):
    rows = generate.fan_out(_values(v, "normal"), 3, "pod")
    return rows.select("sensor", "row_id", "temperature", F.round("humidity", 6).alias("humidity"))


@query(
    "gen_telemetry",
    f"""WITH vals AS ({_VALUES}),
       n AS (SELECT *, row_number() OVER (ORDER BY row_id) AS pos FROM vals WHERE class = 'normal'),
       a AS (SELECT *, row_number() OVER (ORDER BY row_id) AS k FROM vals WHERE class = 'abnormal'),
       d AS (SELECT n.pos, n.row_id, coalesce(a.temperature, n.temperature) AS temperature,
               coalesce(a.humidity, n.humidity) AS humidity,
               coalesce(sum(({list(DELAYS_MS)})[CAST((pos - 1) % 10 + 1 AS INTEGER)])
                 OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift
             FROM n LEFT JOIN a ON n.pos = a.k * 10)
       SELECT 'pod-' || s::VARCHAR AS sensor, pos, CAST({EPOCH * 1000} + shift AS BIGINT) AS measurement_ts,
         temperature, humidity FROM d, range(2) r(s)""",
)
def gen_telemetry(v):
    """Two sensors send the value file with every tenth value abnormal."""
    rows = generate.telemetry(
        _values(v, "normal"),
        _values(v, "abnormal"),
        sensors=2,
        pod="pod",
        mode="mixed",
        every=10,
        delay=DELAYS_MS,
        start_ms=EPOCH * 1000,
        on_exhausted="keep",
    )
    return rows.select(
        "sensor", "pos", "measurement_ts", "temperature", F.round("humidity", 6).alias("humidity")
    )


@query(
    "send_times",
    f"""SELECT event_id, sensor, pos, CAST(coalesce(sum(delay) OVER (PARTITION BY sensor ORDER BY pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS send_offset
       FROM (SELECT *, ({list(DELAYS_MS)})[CAST((pos - 1) % 10 + 1 AS INTEGER)] AS delay
         FROM (SELECT event_id, sensor, row_number() OVER (PARTITION BY sensor ORDER BY event_id) AS pos FROM readings))""",
    "readings",
)
def send_times(v):
    rows = v.readings().select("event_id", "sensor")
    return numbering.send_times(rows, DELAYS_MS, ["sensor"], "event_id")


_RANDOM_DELAY = (
    f"CAST(round({_draw('s4:delay', "sensor || '#' || ((pos - 1) % 10)::VARCHAR")} * 1000.0 + 1000.0) AS BIGINT)"
)


@query(
    "send_times_random",
    f"""SELECT event_id, pos, CAST(coalesce(sum(delay) OVER (PARTITION BY sensor ORDER BY pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS send_offset
       FROM (SELECT *, {_RANDOM_DELAY} AS delay
         FROM (SELECT event_id, sensor, row_number() OVER (PARTITION BY sensor ORDER BY event_id) AS pos FROM readings))""",
    "readings",
)
def send_times_random(v):
    """Ten random delays between one and two seconds per sensor, repeated."""
    rows = numbering.positions(v.readings().select("event_id", "sensor"), ["sensor"], "event_id")
    return generate.with_random_offset(rows, 1, 2, "s4").select("event_id", "pos", "send_offset")


@query(
    "inject_every_nth",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY event_id) AS pos FROM readings
         WHERE temperature <= 100),
       a AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY event_id) AS turn FROM readings
         WHERE temperature > 100)
       SELECT n.event_id, n.sensor, n.pos, coalesce(a.temperature, n.temperature) AS temperature,
         coalesce(a.humidity, n.humidity) AS humidity, a.turn IS NOT NULL AS injected
       FROM n LEFT JOIN a ON n.sensor = a.sensor AND n.pos = a.turn * 10""",
    "readings",
)
def inject_every_nth(v):
    rows = v.readings().select("event_id", "sensor", "temperature", "humidity")
    hot = F.col("temperature") > 100
    return numbering.inject_every_nth(
        rows.filter(~hot),
        rows.filter(hot),
        10,
        ["sensor"],
        "event_id",
        ["temperature", "humidity"],
        on_exhausted="keep",
    )


@query(
    "sorted_values",
    """SELECT row_number() OVER (ORDER BY floor(o_totalprice), o_orderkey) AS id, 'server-1' AS server,
       'client-1' AS client, 'mergesort' AS algorithm, CAST(floor(o_totalprice) AS BIGINT) AS value FROM orders""",
)
def sorted_values(v):
    """Sorted values with consecutive ids; the algorithm is a label, the result is the same."""
    rows = v.table("orders").select(
        "o_orderkey", F.floor("o_totalprice").cast("bigint").alias("value")
    )
    return numbering.sequential_ids(rows, ["value", "o_orderkey"]).select(
        "id",
        F.lit("server-1").alias("server"),
        F.lit("client-1").alias("client"),
        F.lit("mergesort").alias("algorithm"),
        "value",
    )


@query(
    "matmul_coo",
    """WITH e AS (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS d,
         unnest(embedding)::DOUBLE AS x FROM embeddings)
       SELECT CAST(a.d AS INTEGER) AS i, CAST(b.d AS INTEGER) AS j,
         CAST(sum(CAST(floor(a.x * 1000) AS BIGINT) * CAST(floor(b.x * 1000) AS BIGINT)) AS BIGINT) AS v
       FROM e a JOIN e b USING (vec_id) GROUP BY a.d, b.d""",
)
def matmul_coo(v):
    """Transposed embeddings times embeddings: inner index is the vector, result is d x d."""
    cells = v.table("embeddings").select("vec_id", F.posexplode("embedding").alias("d", "x"))
    value = F.floor(F.col("x").cast("double") * 1000).cast("bigint").alias("v")
    d = F.col("d") + 1
    transposed = cells.select(d.alias("i"), F.col("vec_id").alias("j"), value)
    plain = cells.select(F.col("vec_id").alias("i"), d.alias("j"), value)
    return joins.matrix_product(transposed, plain)
