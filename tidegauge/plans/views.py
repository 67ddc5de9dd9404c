"""Telemetry views over the driver tables, in Spark and as SQL for the oracle.

The driver tables are a general star schema. Each view derives one input of the operators
from them, row for row, so the work of every query grows with the tables.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import readings as ops
from ..session import apply_runtime_conf

EPOCH = 1_704_067_200  # 2024-01-01 00:00:00 UTC, start of the events table

# Validity range and action thresholds used over the view.
LOW, HIGH, MINIMUM, MAXIMUM = 0, 100, 10, 80


def _digits(column: Column) -> Column:
    return F.regexp_extract(column, "([0-9]+)", 1).cast("int")


def _text(prefix: str, number: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), number.cast("string"), F.lit(suffix))


class Views:
    """Lazily built views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = apply_runtime_conf(spark)
        self.folder = folder
        self._schemas: dict = {}

    def table(self, name: str) -> DataFrame:
        """One driver table; its schema is read from the footer once per query."""
        path = f"{self.folder}/{name}.parquet"
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[name]).parquet(path)

    def ev(self, since_s: int | None = None, until_s: int | None = None) -> DataFrame:
        """Events; ``[since_s, until_s)`` is applied to the stored column and reaches the scan."""
        rows = self.table("events")
        for bound, compare in ((since_s, "__ge__"), (until_s, "__lt__")):
            if bound is not None:
                at = datetime(1970, 1, 1) + timedelta(seconds=bound)
                rows = rows.filter(getattr(F.col("ts"), compare)(F.lit(at).cast("timestamp_ntz")))
        return rows.select(
            "event_id",
            "user_id",
            "event_type",
            "value",
            _digits(F.col("props")).alias("k"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        )

    def readings(self, since_s: int | None = None, until_s: int | None = None) -> DataFrame:
        return self.ev(since_s, until_s).select(
            "event_id",
            F.col("ms").alias("measurement_ts"),
            F.floor("value").cast("int").alias("temperature"),
            F.col("k").cast("double").alias("humidity"),
            _text("sensor-", F.col("user_id")).alias("sensor"),
            F.expr("ms div 1000").alias("reading_ts"),
            "event_type",
            "k",
        )

    def telemetry(self) -> DataFrame:
        """Well-formed device text."""
        return ops.compose_telemetry(self.readings()).select("event_id", "value")

    def raw_telemetry(self) -> DataFrame:
        """Device text where the readings of ``error`` events are damaged in five ways."""
        good = ops.compose_telemetry(self.readings())
        kind = F.pmod("k", F.lit(5))

        def message(ts: Column, temperature: Column, humidity: Column) -> Column:
            return F.concat(
                F.lit('{"measurement_ts":'), ts, F.lit(',"temperature":'), temperature,
                F.lit(',"humidity":'), humidity, F.lit(',"sensor":'), F.col("sensor"), F.lit("}"),
            )

        ts = F.col("measurement_ts").cast("string")
        temperature = F.col("temperature").cast("string")
        humidity = F.col("humidity").cast("string")
        damaged = (
            F.when(kind == 0, message(ts, temperature, F.lit(",")))
            .when(kind == 1, message(ts, F.concat(temperature, F.lit(".3")), humidity))
            .when(kind == 2, _text("junk ", F.col("k")))
            .when(kind == 3, message(F.lit("99"), temperature, humidity))
            .otherwise(message(ts, temperature, F.lit("nan")))
        )
        return good.select(
            "event_id",
            F.when(F.col("event_type") == "error", damaged).otherwise(F.col("value")).alias("value"),
        )

    def typed(self) -> DataFrame:
        return ops.type_readings(ops.parse_telemetry(self.telemetry()))

    def valid(self) -> DataFrame:
        return ops.route(self.typed(), LOW, HIGH).valid

    def store(self, since_s: int | None = None, until_s: int | None = None) -> DataFrame:
        """Valid readings as stored: times as text, humidity as FLOAT."""
        rows = self.readings(since_s, until_s).filter(F.col("temperature").between(LOW, HIGH))
        return rows.select(
            F.col("event_id").alias("id"),
            F.col("reading_ts").cast("string").alias("readingTS"),
            (F.col("reading_ts") + F.col("k")).cast("string").alias("processTS"),
            F.col("sensor").alias("sensorID"),
            "temperature",
            F.col("humidity").cast("float").alias("humidity"),
        )

    def metrics(self, since_s: int | None = None, until_s: int | None = None) -> DataFrame:
        user = F.col("user_id")
        return self.ev(since_s, until_s).select(
            "event_id",
            "ms",
            F.expr("ms div 1000").alias("ts"),
            _text("ns-", user % 2).alias("namespace"),
            _text("worker", user % 3 + 1).alias("host"),
            _text("app-", user % 7, "-pod").alias("pod_name"),
            F.col("event_type").alias("container_name"),
            (F.col("value") * 1_000_000).alias("value"),
            F.col("k").alias("counter"),
            _text("wl-", user % 42).alias("wl"),
        )

    def pod_info(self) -> DataFrame:
        return (
            self.metrics()
            .select("namespace", "host", "pod_name", F.col("wl").alias("label_workload_id"))
            .distinct()
            .filter(~F.col("label_workload_id").isin("wl-0", "wl-5", "wl-10"))
        )

    def logs(self) -> DataFrame:
        return self.metrics().select(
            "event_id",
            "ms",
            "namespace",
            "wl",
            "pod_name",
            F.nullif("container_name", F.lit("view")).alias("status"),
        )

    def health(self) -> DataFrame:
        return self.ev().select(
            _text("inst-", F.col("user_id") % 10).alias("instance"),
            F.lit("telegraf").alias("job"),
            F.lit("/").alias("path"),
            "ms",
            "event_id",
            F.when(F.col("value") < 50, 0).otherwise(1).alias("up"),
            F.col("value").alias("disk_used_percent"),
        )

    def deployed(self) -> DataFrame:
        key = F.col("o_orderkey")
        created = F.lit(EPOCH) + (key * 7919) % 2_592_000
        micros = (key * 7919) % 1_000_000
        status = F.col("o_orderstatus")
        at = F.timestamp_seconds(created)
        return self.table("orders").select(
            key.alias("workload_id"),
            _text("user-", F.col("o_custkey")).alias("username"),
            _text("type-", key % 17).alias("workload_name"),
            ((key % 48 + 1) * 3600).cast("int").alias("duration"),
            F.lit("success").alias("deployment_status"),
            F.when(status == "F", True).when(status == "O", False).alias("is_completed"),
            at.alias("created_at"),
            at.alias("finished_at"),
            F.when(key % 3 == 0, key).alias("yaml_workload_id"),
            F.when(key % 3 == 1, key).alias("helm_workload_id"),
            created.alias("created_s"),
            F.concat(
                F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"),
                F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(
                    F.lit("")
                ),
            ).alias("created_text"),
            _text("wl-", key % 42).alias("wl"),
            _text("ns-", key % 2).alias("namespace"),
        )

    def yaml(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").filter(key % 3 == 0).select(
            key.alias("id"),
            (key % 5 + 1).cast("int").alias("replicas"),
            F.when(key % 4 == 0, F.lit("null")).otherwise(_text("worker", key % 3 + 1)).alias("node_name"),
        )

    def helm(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").filter(key % 3 == 1).select(
            key.alias("id"),
            _text("chart-", key % 6).alias("chart_name"),
            F.when(key % 4 == 1, F.lit("null")).otherwise(_text("1.", key % 10)).alias("chart_version"),
            F.when(key % 5 == 0, F.lit("null"))
            .when(key % 5 == 1, F.lit(""))
            .otherwise(F.concat(_text("size=", key % 7), _text(" ; name=n", key % 9)))
            .alias("set_values"),
        )

    def types(self) -> DataFrame:
        """Types seen in orders; two of them also exist as a user's own."""
        n = F.col("n")
        own = F.col("created_by") != "admin"
        return (
            self.table("orders")
            .select((F.col("o_orderkey") % 17).alias("n"))
            .distinct()
            .withColumn(
                "created_by",
                F.explode(
                    F.when(n.isin(3, 7), F.array(F.lit("admin"), F.lit("user-5"))).otherwise(
                        F.array(F.lit("admin"))
                    )
                ),
            )
            .select(
                _text("type-", n).alias("workload_name"),
                (n % 4 != 3).alias("workload_enabled"),
                F.when((n % 2 == 0) | own, F.lit("yaml")).otherwise(F.lit("helm")).alias("deploy_method"),
                _text("repo-", n).alias("helm_repo_name"),
                _text("http://charts/", n).alias("helm_repo_url"),
                F.when(own, _text("own-", n)).otherwise(_text("chart-", n)).alias("helm_chart"),
                _text("2.", n).alias("helm_chart_version"),
                _text("n=", n).alias("helm_set_values"),
                "created_by",
            )
        )

    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        name = _text("user-", key)
        return self.table("customer").select(
            key.alias("id"),
            name.alias("username"),
            F.when(key == 0, F.lit("admin")).otherwise(F.lit("user")).alias("role"),
            F.lower("c_mktsegment").alias("user_level"),
            text.namespace_of(name).alias("namespace"),
            (F.col("c_nationkey") + 1).cast("int").alias("quota_pods"),
            F.lit("1000m").alias("quota_cpu"),
            F.lit("1Gi").alias("quota_memory"),
        )


# The same views as SQL: name -> (views it reads, text).
_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": (
        (),
        """SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ms,
           CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events""",
    ),
    "readings": (
        ("ev",),
        """SELECT event_id, ms AS measurement_ts, CAST(floor(value) AS INTEGER) AS temperature,
           CAST(k AS DOUBLE) AS humidity, 'sensor-' || user_id::VARCHAR AS sensor,
           ms // 1000 AS reading_ts, event_type, k FROM ev""",
    ),
    "telemetry": (
        ("readings",),
        """SELECT event_id, '{"measurement_ts":' || measurement_ts::VARCHAR || ',"temperature":'
           || temperature::VARCHAR || ',"humidity":' || humidity::VARCHAR || ',"sensor":' || sensor
           || '}' AS value FROM readings""",
    ),
    "raw_telemetry": (
        ("readings",),
        """SELECT event_id, CASE WHEN event_type = 'error' AND k % 5 = 2 THEN 'junk ' || k::VARCHAR
           ELSE '{"measurement_ts":'
             || CASE WHEN event_type = 'error' AND k % 5 = 3 THEN '99' ELSE measurement_ts::VARCHAR END
             || ',"temperature":' || temperature::VARCHAR
             || CASE WHEN event_type = 'error' AND k % 5 = 1 THEN '.3' ELSE '' END
             || ',"humidity":' || CASE WHEN event_type = 'error' AND k % 5 = 0 THEN ','
                  WHEN event_type = 'error' AND k % 5 = 4 THEN 'nan' ELSE humidity::VARCHAR END
             || ',"sensor":' || sensor || '}' END AS value FROM readings""",
    ),
    "fields": (
        ("raw_telemetry",),
        """SELECT event_id, value,
           string_split(string_split(value, ',')[1], ':')[2] AS measurement_ts,
           string_split(string_split(value, ',')[2], ':')[2] AS temperature,
           string_split(string_split(value, ',')[3], ':')[2] AS humidity,
           string_split(string_split(value, ',')[4], ':')[2] AS sensor_text FROM raw_telemetry""",
    ),
    "typed": (
        ("fields",),
        r"""SELECT event_id, value,
           CASE WHEN regexp_full_match(temperature, '\s*[+-]?[0-9]+\s*')
                THEN TRY_CAST(temperature AS INTEGER) END AS temperature,
           TRY_CAST(humidity AS DOUBLE) AS humidity,
           CASE WHEN length(measurement_ts) > 3
                THEN TRY_CAST(left(measurement_ts, length(measurement_ts) - 3) AS BIGINT) END AS reading_ts,
           left(sensor_text, length(sensor_text) - 1) AS sensor,
           measurement_ts IS NULL OR temperature IS NULL OR humidity IS NULL OR sensor_text IS NULL
             AS missing FROM fields""",
    ),
    "store": (
        ("readings",),
        f"""SELECT event_id AS id, reading_ts, reading_ts + k AS process_ts, sensor AS sensorID, temperature,
           CAST(humidity AS FLOAT) AS humidity FROM readings WHERE temperature BETWEEN {LOW} AND {HIGH}""",
    ),
    "metrics": (
        ("ev",),
        """SELECT event_id, ms, ms // 1000 AS ts, 'ns-' || (user_id % 2)::VARCHAR AS namespace,
           'worker' || (user_id % 3 + 1)::VARCHAR AS host,
           'app-' || (user_id % 7)::VARCHAR || '-pod' AS pod_name, event_type AS container_name,
           value * 1000000 AS value, k AS counter, 'wl-' || (user_id % 42)::VARCHAR AS wl FROM ev""",
    ),
    "pod_info": (
        ("metrics",),
        """SELECT DISTINCT namespace, host, pod_name, wl AS label_workload_id FROM metrics
           WHERE wl NOT IN ('wl-0', 'wl-5', 'wl-10')""",
    ),
    "logs": (
        ("metrics",),
        """SELECT event_id, ms, namespace, wl, pod_name, nullif(container_name, 'view') AS status FROM metrics""",
    ),
    "health": (
        ("ev",),
        """SELECT 'inst-' || (user_id % 10)::VARCHAR AS instance, 'telegraf' AS job, '/' AS path, ms, event_id,
           CASE WHEN value < 50 THEN 0 ELSE 1 END AS up, value AS disk_used_percent FROM ev""",
    ),
    "wl_deployed": (
        (),
        f"""SELECT o_orderkey AS workload_id, 'user-' || o_custkey::VARCHAR AS username,
           'type-' || (o_orderkey % 17)::VARCHAR AS workload_name,
           CAST((o_orderkey % 48 + 1) * 3600 AS INTEGER) AS duration,
           CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS is_completed,
           {EPOCH} + (o_orderkey * 7919) % 2592000 AS created_s, (o_orderkey * 7919) % 1000000 AS micros,
           'wl-' || (o_orderkey % 42)::VARCHAR AS wl, 'ns-' || (o_orderkey % 2)::VARCHAR AS namespace
           FROM orders""",
    ),
    "wl_yaml": (
        (),
        """SELECT o_orderkey AS id, CAST(o_orderkey % 5 + 1 AS INTEGER) AS replicas,
           CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE 'worker' || (o_orderkey % 3 + 1)::VARCHAR END
             AS node_name FROM orders WHERE o_orderkey % 3 = 0""",
    ),
    "wl_helm": (
        (),
        """SELECT o_orderkey AS id, 'chart-' || (o_orderkey % 6)::VARCHAR AS chart_name,
           CASE WHEN o_orderkey % 4 = 1 THEN 'null' ELSE '1.' || (o_orderkey % 10)::VARCHAR END AS chart_version,
           CASE o_orderkey % 5 WHEN 0 THEN 'null' WHEN 1 THEN ''
             ELSE 'size=' || (o_orderkey % 7)::VARCHAR || ' ; name=n' || (o_orderkey % 9)::VARCHAR END AS set_values
           FROM orders WHERE o_orderkey % 3 = 1""",
    ),
    "wl_type": (
        (),
        """SELECT 'type-' || n::VARCHAR AS workload_name, n % 4 <> 3 AS workload_enabled,
           CASE WHEN n % 2 = 0 OR created_by <> 'admin' THEN 'yaml' ELSE 'helm' END AS deploy_method,
           'repo-' || n::VARCHAR AS helm_repo_name, 'http://charts/' || n::VARCHAR AS helm_repo_url,
           CASE WHEN created_by <> 'admin' THEN 'own-' ELSE 'chart-' END || n::VARCHAR AS helm_chart,
           '2.' || n::VARCHAR AS helm_chart_version, 'n=' || n::VARCHAR AS helm_set_values, created_by
           FROM (SELECT DISTINCT o_orderkey % 17 AS n, 'admin' AS created_by FROM orders UNION ALL
                 SELECT DISTINCT o_orderkey % 17, 'user-5' FROM orders WHERE o_orderkey % 17 IN (3, 7))""",
    ),
    "wl_user": (
        (),
        """SELECT c_custkey AS id, 'user-' || c_custkey::VARCHAR AS username,
           CASE WHEN c_custkey = 0 THEN 'admin' ELSE 'user' END AS role, lower(c_mktsegment) AS user_level,
           CAST(c_nationkey + 1 AS INTEGER) AS quota_pods, '1000m' AS quota_cpu, '1Gi' AS quota_memory
           FROM customer""",
    ),
    "wl_list": (
        ("wl_deployed", "wl_yaml", "wl_helm", "wl_type", "wl_user"),
        """SELECT d.*, strftime(make_timestamp(d.created_s * 1000000), '%Y-%m-%dT%H:%M:%S')
             || CASE WHEN d.micros > 0 THEN '.' || lpad(d.micros::VARCHAR, 6, '0') ELSE '' END AS created_text,
           y.replicas, y.node_name, h.chart_name, h.chart_version, h.set_values,
           CASE WHEN o.workload_name IS NOT NULL THEN o.deploy_method ELSE t.deploy_method END AS deploy_method,
           CASE WHEN o.workload_name IS NOT NULL THEN o.helm_repo_name ELSE t.helm_repo_name END AS helm_repo_name,
           CASE WHEN o.workload_name IS NOT NULL THEN o.helm_repo_url ELSE t.helm_repo_url END AS helm_repo_url,
           CASE WHEN o.workload_name IS NOT NULL THEN o.helm_chart ELSE t.helm_chart END AS helm_chart,
           CASE WHEN o.workload_name IS NOT NULL THEN o.helm_chart_version ELSE t.helm_chart_version END
             AS helm_chart_version,
           CASE WHEN o.workload_name IS NOT NULL THEN o.helm_set_values ELSE t.helm_set_values END AS helm_set_values
           FROM wl_deployed d
           LEFT JOIN wl_yaml y ON d.workload_id % 3 = 0 AND y.id = d.workload_id
           LEFT JOIN wl_helm h ON d.workload_id % 3 = 1 AND h.id = d.workload_id
           JOIN wl_type t ON t.workload_name = d.workload_name AND t.created_by = 'admin'
           LEFT JOIN wl_type o ON o.workload_name = d.workload_name AND o.created_by = d.username
           JOIN wl_user u ON u.username = d.username
           WHERE y.id IS NOT NULL OR h.id IS NOT NULL""",
    ),
}


def oracle(body: str, *views: str) -> str:
    """SQL text of a query over the named views."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for dependency in _SQL[name][0]:
            need(dependency)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        need(view)
    ctes = ",\n".join(f"{name} AS ({_SQL[name][1]})" for name in ordered)
    if not ctes:
        return body
    own = body.lstrip()
    # A body with CTEs of its own continues the list.
    return f"WITH {ctes},\n{own[5:]}" if own.startswith("WITH ") else f"WITH {ctes}\n{body}"
