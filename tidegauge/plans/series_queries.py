"""Queries over metric and log series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import inventory, joins, series as ops
from ..sources import readers
from .registry import query
from .views import EPOCH

DAY_MS = 86_400_000
HOSTS = ("worker1", "worker2")


@query(
    "metric_series",
    """SELECT ts, host, round(value / 1000000, 6) AS value FROM metrics
       WHERE container_name = 'click' AND host IN ('worker1', 'worker2')""",
    "metrics",
)
def metric_series(v):
    rows = v.metrics().filter((F.col("container_name") == "click") & F.col("host").isin(*HOSTS))
    return rows.select("ts", "host", F.round(F.col("value") / 1e6, 6).alias("value"))


@query(
    "pod_list_series",
    """SELECT ts, pod_name, round(value / 1000000, 6) AS value FROM metrics
       WHERE pod_name IN ('app-1-pod', 'app-2-pod', 'app-3-pod', 'app-4-pod')""",
    "metrics",
)
def pod_list_series(v):
    pods = [f"app-{n}-pod" for n in range(1, 5)]
    rows = v.metrics().filter(F.col("pod_name").isin(pods))
    return rows.select("ts", "pod_name", F.round(F.col("value") / 1e6, 6).alias("value"))


@query(
    "time_range_exclusive",
    f"SELECT event_id, ts, pod_name FROM metrics WHERE ts > {EPOCH + 864000} AND ts < {EPOCH + 1728000}",
    "metrics",
)
def time_range_exclusive(v):
    first, last = EPOCH + 864_000, EPOCH + 1_728_000
    rows = v.metrics(since_s=first + 1, until_s=last)
    return rows.filter((F.col("ts") > first) & (F.col("ts") < last)).select("event_id", "ts", "pod_name")


@query(
    "pod_short_name",
    """SELECT event_id, left(pod, length(pod) - 14) AS short_name FROM (SELECT event_id, pod_name || '-'
       || substr(md5(event_id::VARCHAR), 1, 10) || '-' || substr(md5(event_id::VARCHAR), 11, 5) AS pod FROM metrics)""",
    "metrics",
)
def pod_short_name(v):
    digest = F.md5(F.col("event_id").cast("string"))
    pod = F.concat_ws("-", "pod_name", F.substring(digest, 1, 10), F.substring(digest, 11, 5))
    return v.metrics().select("event_id", text.short_pod_name(pod).alias("short_name"))


@query(
    "label_match",
    """SELECT event_id, namespace, container_name FROM metrics WHERE namespace = 'ns-1'
       AND regexp_full_match(container_name, 'click|view') AND regexp_full_match(pod_name, '.+')
       AND regexp_full_match(wl, 'wl-[12].*')""",
    "metrics",
)
def label_match(v):
    return (
        v.metrics()
        .filter(
            (F.col("namespace") == "ns-1")
            & text.full_match(F.col("container_name"), "click|view")
            & text.full_match(F.col("pod_name"), ".+")
            & text.full_match(F.col("wl"), "wl-[12].*")
        )
        .select("event_id", "namespace", "container_name")
    )


@query(
    "field_allowlist",
    """WITH samples AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'mem' WHEN 'view' THEN 'disk'
         WHEN 'purchase' THEN 'net' WHEN 'signup' THEN 'diskio' ELSE 'kubernetes_' ||
           CASE WHEN user_id % 2 = 0 THEN 'pod_network' ELSE 'node' END END AS measurement,
         (['used', 'free', 'cached', 'reads', 'read_time', 'bytes_sent'])
           [CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 6 + 1] AS field,
         (['ext4', 'tmpfs', 'overlay', 'loop3', 'xfs'])[user_id % 5 + 1] AS fstype,
         (['eth0', 'ens3', 'lo', 'sda', 'vda', 'sdd'])[user_id % 6 + 1] AS device FROM events)
       SELECT event_id, measurement, field, fstype, device FROM samples
       WHERE (measurement <> 'mem' OR field IN ('available', 'free', 'total', 'used_percent'))
         AND (measurement <> 'disk' OR (field IN ('free', 'used', 'total', 'used_percent')
              AND fstype NOT IN ('tmpfs', 'devtmpfs', 'devfs', 'iso9660', 'overlay', 'aufs', 'squashfs')
              AND fstype NOT LIKE 'loop%'))
         AND (measurement <> 'diskio' OR (field IN ('read_time', 'write_time', 'reads', 'writes', 'io_time')
              AND device IN ('sda', 'sdb', 'sdc', 'vda')))
         AND (measurement <> 'net' OR regexp_full_match(device, '(eth|ens|eno).*'))
         AND measurement <> 'kubernetes_node'""",
)
def field_allowlist(v):
    def pick(names: list[str], index):
        return F.element_at(F.array(*[F.lit(n) for n in names]), index.cast("int") + 1)

    kind = F.col("event_type")
    pod = F.when(F.col("user_id") % 2 == 0, "kubernetes_pod_network").otherwise("kubernetes_node")
    samples = v.ev().select(
        "event_id",
        F.when(kind == "click", "mem").when(kind == "view", "disk").when(kind == "purchase", "net")
        .when(kind == "signup", "diskio").otherwise(pod).alias("measurement"),
        pick(["used", "free", "cached", "reads", "read_time", "bytes_sent"], F.col("k") % 6).alias("field"),
        pick(["ext4", "tmpfs", "overlay", "loop3", "xfs"], F.col("user_id") % 5).alias("fstype"),
        pick(["eth0", "ens3", "lo", "sda", "vda", "sdd"], F.col("user_id") % 6).alias("device"),
    )
    return inventory.allowed_fields(samples)


@query(
    "pod_labels",
    """SELECT DISTINCT namespace, pod_name, host, 'label_workload_id' AS label, wl AS value FROM metrics
         WHERE container_name <> 'error'
       UNION ALL SELECT DISTINCT namespace, pod_name, host, 'label_workload_id_run_v1', container_name FROM metrics
         WHERE container_name = 'purchase'""",
    "metrics",
)
def pod_labels(v):
    """Pods of ``error`` containers carry no workload label, those of ``purchase`` two."""
    kind = F.col("container_name")
    name = F.map_from_arrays(F.array(F.lit("app.x")), F.array(F.col("pod_name")))
    workload = F.create_map(F.lit("workload_id"), F.col("wl"))
    run = F.create_map(F.lit("workload_id-run.v1"), kind)
    labels = (
        F.when(kind == "error", name)
        .when(kind == "purchase", F.map_concat(name, workload, run))
        .otherwise(F.map_concat(name, workload))
    )
    # The inventory lists a pod once, so its rows are distinct before maps are built.
    listed = v.metrics().select("namespace", "pod_name", "host", "wl", "container_name").distinct()
    pods = listed.select("namespace", "pod_name", "host", labels.alias("labels"))
    kept = inventory.pod_labels(pods)
    return kept.select(
        "namespace", "pod_name", "host", F.explode("labels").alias("label", "value")
    ).distinct()


@query(
    "ready_nodes",
    """SELECT 'node-' || s_suppkey::VARCHAR AS node FROM supplier WHERE s_acctbal > 0 AND s_nationkey <> 0""",
)
def ready_nodes(v):
    ready = F.when(F.col("s_acctbal") > 0, "True").otherwise("False")
    host = F.concat(F.lit("node-"), F.col("s_suppkey").cast("string"))

    def pair(first, second, names):
        return F.struct(first.alias(names[0]), second.alias(names[1]))

    nodes = v.table("supplier").select(
        F.when(
            F.col("s_nationkey") == 0, F.create_map(F.lit(inventory.CONTROL_PLANE), F.lit(""))
        ).otherwise(F.create_map(F.lit("zone"), F.lit("a"))).alias("labels"),
        F.array(
            pair(F.lit("DiskPressure"), F.lit("True"), ("type", "status")),
            pair(F.lit("Ready"), ready, ("type", "status")),
        ).alias("conditions"),
        F.array(
            pair(F.lit("InternalIP"), F.lit("10.0.0.1"), ("type", "address")),
            pair(F.lit("Hostname"), host, ("type", "address")),
        ).alias("addresses"),
    )
    return inventory.ready_nodes(nodes)


@query(
    "label_join_cpu",
    """SELECT m.event_id, m.ts, i.label_workload_id, round(m.value / 1000000, 6) AS value FROM metrics m
       JOIN pod_info i USING (namespace, host, pod_name)
       WHERE regexp_full_match(i.label_workload_id, 'wl-1.*')""",
    "metrics",
    "pod_info",
)
def label_join_cpu(v):
    wanted = text.full_match(F.col("label_workload_id"), "wl-1.*")
    joined = joins.label_join(v.metrics(), v.pod_info(), matcher=wanted)
    return joined.select(
        "event_id", "ts", "label_workload_id", F.round(F.col("value") / 1e6, 6).alias("value")
    )


@query(
    "workload_window_join",
    """SELECT d.workload_id, m.event_id, m.ts, m.container_name FROM metrics m
       JOIN wl_deployed d ON CASE WHEN m.event_id % 3 = 0 THEN 47 ELSE m.event_id // 8 + 1 END = d.workload_id
       AND m.namespace = d.namespace
       AND m.ts BETWEEN d.created_s - 60 AND d.created_s + d.duration + 60""",
    "metrics",
    "wl_deployed",
)
def workload_window_join(v):
    """A sample carries the id of one workload and its namespace; a third of all are of one workload."""
    owner = F.when(F.col("event_id") % 3 == 0, F.lit(47).cast("bigint")).otherwise(F.expr("event_id div 8 + 1"))
    samples = v.metrics().select("event_id", "ts", owner.alias("owner"), "namespace", "container_name")
    workloads = v.deployed().select(
        "workload_id", "created_s", "duration", F.col("workload_id").alias("owner"), "namespace"
    )
    return joins.window_join(samples, workloads, "ts", ["owner", "namespace"]).select(
        "workload_id", "event_id", "ts", "container_name"
    )


@query(
    "label_join_over_time",
    """WITH shown AS (
         SELECT DISTINCT namespace, host, pod_name, ts // 3600 * 3600 AS shown_at,
           'wl-' || ((regexp_extract(wl, '([0-9]+)', 1)::BIGINT + ts // 604800) % 42)::VARCHAR AS label_workload_id
         FROM metrics WHERE container_name IN ('view', 'click')
       ), seen AS (
         SELECT m.event_id, m.ts, m.namespace, m.host, m.pod_name, max(s.shown_at) AS shown_at FROM metrics m
         JOIN shown s USING (namespace, host, pod_name) WHERE s.shown_at <= m.ts AND m.ts < s.shown_at + 21600 GROUP BY ALL
       )
       SELECT e.event_id, e.ts, s.label_workload_id FROM seen e JOIN shown s USING (namespace, host, pod_name, shown_at)""",
    "metrics",
)
def label_join_over_time(v):
    """Hourly snapshots of pods that move to another workload every week; a pod is forgotten after six hours."""
    number = F.regexp_extract("wl", "([0-9]+)", 1).cast("bigint")
    moved = F.concat(F.lit("wl-"), ((number + F.expr("ts div 604800")) % 42).cast("string"))
    shown = v.metrics().filter(F.col("container_name").isin("view", "click")).select(
        *joins.POD_KEYS, F.expr("ts div 3600 * 3600").alias("at"), moved.alias("label_workload_id")
    )
    samples = v.metrics().select("event_id", "ts", *joins.POD_KEYS)
    joined = joins.label_join_over_time(samples, shown, "ts", "at", stale=21_600)
    return joined.select("event_id", "ts", "label_workload_id")


@query(
    "logs_per_minute",
    """SELECT ms // 60000 * 60000 AS window_ms, pod_name, count(status) AS total FROM logs GROUP BY ALL""",
    "logs",
)
def logs_per_minute(v):
    logs = v.logs().withColumn("ts", F.timestamp_millis("ms"))
    counted = ops.counts(logs, "ts", "1 minute", ["pod_name"], "status")
    return counted.select(F.unix_millis("window_start").alias("window_ms"), "pod_name", "total")


@query(
    "host_mean",
    "SELECT host, round(avg(value / 1000000), 6) AS mean_value FROM metrics GROUP BY host",
    "metrics",
)
def host_mean(v):
    rows = v.metrics().withColumn("value", F.col("value") / 1e6)
    return ops.mean_by(rows, ["host"], "value").withColumn("mean_value", F.round("mean_value", 6))


@query(
    "series_counts",
    """SELECT host AS series, count(*) AS records FROM metrics GROUP BY host
       UNION ALL SELECT 'total', count(*) FROM metrics""",
    "metrics",
)
def series_counts(v):
    return ops.series_counts(v.metrics(), "host")


@query(
    "label_values",
    """SELECT DISTINCT 'namespace' AS label, namespace AS value FROM metrics
       UNION ALL SELECT DISTINCT 'wl', wl FROM metrics UNION ALL SELECT DISTINCT 'pod_name', pod_name FROM metrics""",
    "metrics",
)
def label_values(v):
    return ops.label_values(v.metrics(), ["namespace", "wl", "pod_name"])


@query(
    "count_over_time",
    """SELECT pod_name, ms, n FROM (SELECT DISTINCT pod_name, ms, count(*) OVER (PARTITION BY pod_name ORDER BY ms
       RANGE BETWEEN 1799999 PRECEDING AND CURRENT ROW) AS n FROM logs)""",
    "logs",
)
def count_over_time(v):
    return ops.trailing_count(v.logs(), ["pod_name"], "ms", 1_800_000)


@query(
    "count_over_time_grid",
    """SELECT l.pod_name, s.step, count(*) AS n FROM logs l JOIN
       (SELECT DISTINCT (ms // 600000 + i) * 600000 AS step FROM logs, range(1, 5) r(i)) s
       ON l.ms > s.step - 1800000 AND l.ms <= s.step GROUP BY ALL""",
    "logs",
)
def count_over_time_grid(v):
    return ops.trailing_count_on_grid(v.logs(), ["pod_name"], "ms", 1_800_000, 600_000)


@query(
    "last_not_null",
    """SELECT container_name, arg_max(value, (ms - 1704067200000) * 100000000 + event_id) AS value,
       CASE WHEN arg_max(value, (ms - 1704067200000) * 100000000 + event_id) >= 80 THEN 'red' ELSE 'green' END AS colour
       FROM (SELECT event_id, ms, event_type AS container_name, CASE WHEN k < 80 THEN value END AS value FROM ev)
       WHERE value IS NOT NULL GROUP BY container_name""",
    "ev",
)
def last_not_null(v):
    rows = v.ev().select(
        "event_id",
        "ms",
        F.col("event_type").alias("container_name"),
        F.when(F.col("k") < 80, F.col("value")).alias("value"),
    )
    return ops.last_value(rows, ["container_name"], "ms", "value", "event_id")


@query("roll_sum", "SELECT event_type, CAST(sum(k) AS BIGINT) AS total FROM ev GROUP BY event_type", "ev")
def roll_sum(v):
    return v.ev().groupBy("event_type").agg(F.sum("k").alias("total"))




def _rate_sql(value: str, name: str, sign: str = "", direction: str = "") -> str:
    """One rate as a subquery: increases with resets over the distance of first and last."""
    return f"""SELECT pod_name, win * {DAY_MS} AS window_start, {direction} count(*) AS samples,
       CAST(sum(CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END) AS BIGINT) AS increase,
       round({sign} sum(CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END)
         / ((max(ms) - min(ms)) / 1000.0), 9) AS rate
       FROM (SELECT *, ms // {DAY_MS} AS win,
               lag(v) OVER (PARTITION BY pod_name, ms // {DAY_MS} ORDER BY ms) AS p
             FROM (SELECT pod_name, ms, arg_max({value}, event_id) AS v FROM metrics GROUP BY ALL)) {name}
       GROUP BY pod_name, win HAVING max(ms) > min(ms)"""


@query("counter_rate", _rate_sql("counter", "c"), "metrics")
def counter_rate(v):
    rates = ops.rate(v.metrics(), ["pod_name"], "ms", "counter", DAY_MS, "event_id")
    return rates.withColumn("rate", F.round("rate", 9))


@query(
    "network_two_way",
    _rate_sql("counter", "t", direction="'tx' AS direction,")
    + " UNION ALL "
    + _rate_sql("100 - counter", "r", "-", "'rx' AS direction,"),
    "metrics",
)
def network_two_way(v):
    sent, received = F.col("counter"), 100 - F.col("counter")
    both = ops.rate_two_way(v.metrics(), ["pod_name"], "ms", sent, received, DAY_MS, "event_id")
    return both.withColumn("rate", F.round("rate", 9))


@query(
    "align_samples",
    """SELECT pod_name, ms // 10000 * 10000 AS step, arg_max(value, (ms - 1704067200000) * 100000000 + event_id) AS value
       FROM metrics GROUP BY ALL""",
    "metrics",
)
def align_samples(v):
    return ops.align(v.metrics(), ["pod_name"], "ms", "value", 10_000, "event_id")


def _sustained_sql(condition: str, hold_ms: int) -> str:
    return f"""SELECT instance, ms, active_since, CASE WHEN ms - active_since >= {hold_ms} THEN 'firing'
         ELSE 'pending' END AS state
       FROM (SELECT *, min(ms) FILTER (WHERE active) OVER (PARTITION BY instance, island) AS active_since FROM
         (SELECT *, sum(CASE WHEN active THEN 0 ELSE 1 END) OVER (PARTITION BY instance ORDER BY ms) AS island
          FROM (SELECT instance, ms, arg_max({condition}, event_id) AS active FROM health GROUP BY ALL)))
       WHERE active"""


@query("alert_sustained", _sustained_sql("up = 0", 21_600_000), "health")
def alert_sustained(v):
    """Host down."""
    return ops.sustained(v.health(), ["instance"], "ms", F.col("up") == 0, 21_600_000, "event_id")


@query("alert_disk_space", _sustained_sql("disk_used_percent > 70", 60_000), "health")
def alert_disk_space(v):
    """Disk filling up, for one path of one job."""
    here = v.health().filter((F.col("job") == "telegraf") & (F.col("path") == "/"))
    full = F.col("disk_used_percent") > 70
    return ops.sustained(here, ["instance"], "ms", full, 60_000, "event_id")


@query(
    "recent_logs",
    """SELECT event_id, ms, pod_name FROM logs WHERE namespace = 'ns-1' AND regexp_full_match(wl, 'wl-.*')
       ORDER BY ms DESC, event_id DESC LIMIT 5000""",
    "logs",
)
def recent_logs(v):
    rows = v.logs().filter((F.col("namespace") == "ns-1") & text.full_match(F.col("wl"), "wl-.*"))
    return ops.newest(rows.select("event_id", "ms", "pod_name"), "ms", tie=["event_id"])


@query(
    "experiment_union",
    """SELECT CASE container_name WHEN 'click' THEN 'pods-50' WHEN 'view' THEN 'pods-80' ELSE 'pods-110' END
       AS experiment, ts, host, round(value / 1000000, 6) AS value FROM metrics
       WHERE container_name IN ('click', 'view', 'purchase')""",
    "metrics",
)
def experiment_union(v):
    """One container per experiment; experiments in files of their own are stacked instead."""
    containers = {"pods-50": "click", "pods-80": "view", "pods-110": "purchase"}
    rows = ops.label_experiments(v.metrics(), "container_name", containers)
    return rows.select("experiment", "ts", "host", F.round(F.col("value") / 1e6, 6).alias("value"))


@query(
    "metric_rows_typed",
    """SELECT ms // 1000 AS timestamp, value, 'worker' || (user_id % 3 + 1)::VARCHAR AS host, event_type AS pod_name
       FROM ev WHERE event_type <> 'signup'""",
    "ev",
)
def metric_rows_typed(v):
    """Text rows of an export in which every ``signup`` row is a repeated header."""
    header = F.col("container_name") == "signup"

    def cell(name, column):
        return F.when(header, F.lit(name)).otherwise(column.cast("string")).alias(name)

    raw = v.metrics().select(
        cell("timestamp", F.col("ts")),
        cell("value", F.col("value") / 1_000_000),
        cell("host", F.col("host")),
        cell("pod_name", F.col("container_name")),
    )
    typed = readers.typed_metrics(raw)
    return typed.select("timestamp", F.round("value", 2).alias("value"), "host", "pod_name")


@query(
    "log_text_times",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE ms // 1000 END AS at FROM ev""",
    "ev",
)
def log_text_times(v):
    """Log times as text; the ones of ``error`` rows are damaged."""
    at = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd HH:mm:ss")
    raw = v.ev().select(
        "event_id", F.when(F.col("event_type") == "error", "no time").otherwise(at).alias("timestamp")
    )
    timed = readers.timed_logs(raw)
    return timed.select(
        "event_id", F.coalesce(F.unix_timestamp("timestamp"), F.lit(-1)).alias("at")
    )


@query(
    "alert_aligned",
    """SELECT instance, step, active_since, CASE WHEN step - active_since >= 21600000 THEN 'firing'
         ELSE 'pending' END AS state
       FROM (SELECT *, min(step) FILTER (WHERE active) OVER (PARTITION BY instance, island) AS active_since FROM
         (SELECT *, sum(CASE WHEN active THEN 0 ELSE 1 END) OVER (PARTITION BY instance ORDER BY step) AS island
          FROM (SELECT instance, ms // 10000 * 10000 AS step,
                  arg_max(up = 0, (ms - 1704067200000) * 100000000 + event_id) AS active
                FROM health GROUP BY ALL)))
       WHERE active""",
    "health",
)
def alert_aligned(v):
    """The alert as a metric server sees it: samples on the collection grid first."""
    grid = ops.align(v.health(), ["instance"], "ms", "up", 10_000, "event_id")
    return ops.sustained(grid, ["instance"], "step", F.col("up") == 0, 21_600_000, unique=True)


@query(
    "network_by_workload",
    f"""WITH rates AS ({_rate_sql("counter", "t").replace("pod_name", "namespace, host, pod_name")})
       SELECT r.*, i.label_workload_id FROM rates r JOIN pod_info i USING (namespace, host, pod_name)""",
    "metrics",
    "pod_info",
)
def network_by_workload(v):
    """Rate of each pod with the workload it belongs to."""
    rates = ops.rate(v.metrics(), list(joins.POD_KEYS), "ms", "counter", DAY_MS, "event_id")
    return joins.label_join(rates.withColumn("rate", F.round("rate", 9)), v.pod_info())


LOOKBACK_MS, STEP_MS = 64_800_000, 14_400_000


@query(
    "rate_grid_by_workload",
    f"""WITH s AS (
         SELECT *, lag(v) OVER (PARTITION BY namespace, host, pod_name ORDER BY ms) AS p FROM (
           SELECT namespace, host, pod_name, ms, arg_max(counter, event_id) AS v FROM metrics GROUP BY ALL)
       ), steps AS (SELECT DISTINCT unnest(range((ms + {STEP_MS} - 1) // {STEP_MS},
           (ms + {LOOKBACK_MS} - 1) // {STEP_MS} + 1)) * {STEP_MS} AS step FROM s
       ), seen AS (
         SELECT namespace, host, pod_name, step, ms, CASE WHEN v < p THEN v ELSE v - p END AS inc,
           min(ms) OVER (PARTITION BY namespace, host, pod_name, step) AS first
         FROM s JOIN steps ON ms > step - {LOOKBACK_MS} AND ms <= step
       ), rates AS (
         SELECT namespace, host, pod_name, step, count(*) AS samples,
           CAST(sum(CASE WHEN ms > first THEN inc ELSE 0 END) AS BIGINT) AS increase,
           round(sum(CASE WHEN ms > first THEN inc ELSE 0 END) / ((max(ms) - min(ms)) / 1000.0), 9) AS rate
         FROM seen GROUP BY ALL HAVING max(ms) > min(ms)
       )
       SELECT r.*, i.label_workload_id FROM rates r JOIN pod_info i USING (namespace, host, pod_name)""",
    "metrics",
    "pod_info",
)
def rate_grid_by_workload(v):
    """Network rate of each pod at every panel step, over a lookback of several steps, with its workload."""
    rates = ops.rate_on_grid(
        v.metrics(), list(joins.POD_KEYS), "ms", "counter", LOOKBACK_MS, STEP_MS, "event_id"
    )
    return joins.label_join(rates.withColumn("rate", F.round("rate", 9)), v.pod_info())
