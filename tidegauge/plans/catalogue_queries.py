"""Queries over the workload catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalogue as ops
from .registry import query
from .views import EPOCH

ASOF = EPOCH + 15 * 86_400


def _listing(v, viewer, role):
    return ops.listing(v.deployed(), v.yaml(), v.helm(), v.types(), v.users(), viewer, role)


def _plain(rows):
    """Listing columns with NULLs as blanks and times as epoch seconds."""
    blank = [
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        for c in ("is_completed", "replicas", "node_name", "chart_name", "chart_version", "set_values")
    ]
    return rows.select(
        "workload_id",
        "workload_name",
        "username",
        "duration",
        "deploy_method",
        F.unix_timestamp("created_at").alias("created_s"),
        *blank,
    )


_LIST = """SELECT workload_id, workload_name, username, duration, deploy_method, created_s,
  coalesce(is_completed::VARCHAR, '') AS is_completed, coalesce(replicas::VARCHAR, '') AS replicas,
  coalesce(node_name, '') AS node_name, coalesce(chart_name, '') AS chart_name,
  coalesce(chart_version, '') AS chart_version, coalesce(set_values, '') AS set_values FROM wl_list"""


@query("wl_list_admin", _LIST, "wl_list")
def wl_list_admin(v):
    return _plain(_listing(v, "user-0", "admin"))


@query("wl_list_user", _LIST + " WHERE username = 'user-5'", "wl_list")
def wl_list_user(v):
    return _plain(_listing(v, "user-5", "user"))


@query(
    "wl_display",
    """SELECT workload_id, workload_name, username, deploy_method,
       CASE WHEN contains(created_text, '.') THEN split_part(created_text, '.', 1) ELSE '' END AS created_at, duration,
       CASE WHEN deploy_method = 'yaml' THEN coalesce(replicas::VARCHAR, '') ELSE '' END AS replicas,
       CASE WHEN deploy_method = 'yaml' THEN coalesce(nullif(node_name, 'null'), '') ELSE '' END AS node_name,
       CASE WHEN deploy_method = 'helm' THEN coalesce(nullif(chart_name, 'null'), '') ELSE '' END AS chart_name,
       CASE WHEN deploy_method = 'helm' THEN coalesce(nullif(chart_version, 'null'), '') ELSE '' END AS chart_version,
       CASE WHEN deploy_method = 'helm' THEN coalesce(nullif(set_values, 'null'), '') ELSE '' END AS set_values,
       CASE WHEN is_completed IS TRUE THEN 'Finished' ELSE 'Running' END AS status FROM wl_list""",
    "wl_list",
)
def wl_display(v):
    return ops.display(_listing(v, "user-0", "admin"))


@query(
    "wl_templates",
    """SELECT workload_name, deploy_method, helm_repo_name, helm_repo_url, helm_chart, helm_chart_version,
       helm_set_values FROM wl_type WHERE workload_enabled AND created_by IN ('user-5', 'admin')""",
    "wl_type",
)
def wl_templates(v):
    return ops.templates(v.types(), "user-5", "user")


_RUNNING = """SELECT d.workload_id, CASE WHEN o.workload_name IS NOT NULL THEN o.deploy_method
    ELSE t.deploy_method END AS deploy_method, d.workload_name, d.duration, d.is_completed, d.username, d.created_s
  FROM wl_deployed d JOIN wl_type t ON t.workload_name = d.workload_name AND t.created_by = 'admin'
  LEFT JOIN wl_type o ON o.workload_name = d.workload_name AND o.created_by = d.username
  WHERE d.is_completed IS FALSE"""


def _running(v, viewer, role):
    rows = ops.running(v.deployed(), v.types(), viewer, role)
    return rows.withColumn("created_s", F.unix_timestamp("created_at")).drop("created_at")


@query("wl_running", _RUNNING, "wl_deployed", "wl_type")
def wl_running(v):
    return _running(v, "user-0", "admin")


@query("wl_running_user", _RUNNING + " AND d.username = 'user-5'", "wl_deployed", "wl_type")
def wl_running_user(v):
    return _running(v, "user-5", "user")


@query(
    "wl_lookup",
    """SELECT 'workload' AS kind, workload_id::VARCHAR AS key, username AS value FROM wl_deployed WHERE workload_id = 42
       UNION ALL SELECT 'user', username, role FROM wl_user WHERE username = 'user-7'
       UNION ALL SELECT 'type', workload_name, helm_chart FROM wl_type
         WHERE workload_name = 'type-3' AND created_by = 'user-5'""",
    "wl_deployed",
    "wl_user",
    "wl_type",
)
def wl_lookup(v):
    """By id, by name and by composite key; the last looks for an id that is not there."""
    def found(kind, rows, key, value):
        return rows.select(
            F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(value).alias("value")
        )

    deployed = v.deployed()
    return (
        found("workload", ops.lookup(deployed, workload_id=42), "workload_id", "username")
        .unionByName(found("user", ops.lookup(v.users(), username="user-7"), "username", "role"))
        .unionByName(
            found(
                "type",
                ops.lookup(v.types(), workload_name="type-3", created_by="user-5"),
                "workload_name",
                "helm_chart",
            )
        )
        .unionByName(found("workload", ops.lookup(deployed, workload_id=-1), "workload_id", "username"))
    )


@query(
    "namespace_name",
    """SELECT c_custkey, left(regexp_replace(lower(c_name || '_' || c_mktsegment), '[^a-z0-9-]', '', 'g'), 45) AS namespace,
       replace(lower(c_mktsegment || ' ' || c_name), ' ', '-') AS workload_name FROM customer""",
)
def namespace_name(v):
    user = F.concat_ws("_", "c_name", "c_mktsegment")
    return v.table("customer").select(
        "c_custkey",
        text.namespace_of(user).alias("namespace"),
        text.workload_name_of(F.concat_ws(" ", "c_mktsegment", "c_name")).alias("workload_name"),
    )


@query(
    "role_name",
    """SELECT c_custkey, regexp_replace(lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR
       ELSE '' END, '[0-9]$', '') AS role FROM customer""",
)
def role_name(v):
    key = F.col("c_custkey")
    name = F.concat(
        F.lower("c_mktsegment"), F.when(key % 2 == 0, key.cast("string")).otherwise(F.lit(""))
    )
    return v.table("customer").select("c_custkey", text.role_of(name).alias("role"))


@query(
    "split_values",
    """SELECT id, trim(pair) AS pair FROM (SELECT id, unnest(string_split(set_values, ';')) AS pair FROM wl_helm
       WHERE set_values IS NOT NULL AND set_values NOT IN ('', 'null'))""",
    "wl_helm",
)
def split_values(v):
    return v.helm().select("id", F.explode(text.set_values(F.col("set_values"))).alias("pair"))


@query(
    "quota_valid",
    """WITH q AS (SELECT event_id, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN ' ' || k::VARCHAR || 'm '
         WHEN 'error' THEN k::VARCHAR ELSE k::VARCHAR || 'm' END AS cpu,
         CASE event_type WHEN 'view' THEN k::VARCHAR || 'Mi' WHEN 'click' THEN k::VARCHAR || 'Gi'
         WHEN 'error' THEN '' ELSE k::VARCHAR || 'G' END AS memory,
         CASE event_type WHEN 'view' THEN '_w' WHEN 'click' THEN 'w ' ELSE 'W-' END || k::VARCHAR AS name FROM ev)
       SELECT event_id, regexp_full_match(trim(cpu), '([0-9]+m)?') AS cpu_ok,
         regexp_full_match(trim(memory), '([0-9]+[MG]i)?') AS memory_ok,
         regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9_-]*') AS name_ok FROM q""",
    "ev",
)
def quota_valid(v):
    k, kind = F.col("k").cast("string"), F.col("event_type")
    cpu = (
        F.when(kind == "view", F.lit(""))
        .when(kind == "click", F.concat(F.lit(" "), k, F.lit("m ")))
        .when(kind == "error", k)
        .otherwise(F.concat(k, F.lit("m")))
    )
    memory = (
        F.when(kind == "view", F.concat(k, F.lit("Mi")))
        .when(kind == "click", F.concat(k, F.lit("Gi")))
        .when(kind == "error", F.lit(""))
        .otherwise(F.concat(k, F.lit("G")))
    )
    name = F.concat(F.when(kind == "view", "_w").when(kind == "click", "w ").otherwise("W-"), k)
    return v.ev().select(
        "event_id",
        text.valid_cpu(cpu).alias("cpu_ok"),
        text.valid_memory(memory).alias("memory_ok"),
        text.valid_workload_name(name).alias("name_ok"),
    )


def _states(rows):
    return rows.select(
        "workload_id",
        F.coalesce(F.col("is_completed").cast("string"), F.lit("")).alias("is_completed"),
        F.unix_timestamp("finished_at").alias("finished_s"),
    )


_STATES = """SELECT workload_id, CASE WHEN {due} THEN 'true' ELSE coalesce(is_completed::VARCHAR, '') END
  AS is_completed, CASE WHEN {due} THEN {at} ELSE created_s END AS finished_s FROM wl_deployed"""


@query(
    "wl_mark_completed",
    _STATES.format(due="(workload_id = 2 AND is_completed IS FALSE)", at=ASOF),
    "wl_deployed",
)
def wl_mark_completed(v):
    return _states(ops.complete(v.deployed(), 2, F.timestamp_seconds(F.lit(ASOF))))


@query(
    "wl_expired",
    _STATES.format(
        due=f"(created_s + duration <= {ASOF} AND is_completed IS FALSE)", at="created_s + duration"
    ),
    "wl_deployed",
)
def wl_expired(v):
    return _states(ops.expire(v.deployed(), F.timestamp_seconds(F.lit(ASOF))))


@query(
    "user_update",
    """SELECT u.username, u.role, CASE WHEN s.s_suppkey IS NULL THEN u.user_level ELSE 'advanced' END AS user_level,
       CASE WHEN s.s_suppkey IS NULL THEN u.quota_pods ELSE CAST(s.s_nationkey AS INTEGER) END AS quota_pods,
       CASE WHEN s.s_acctbal > 0 THEN '2000m' ELSE u.quota_cpu END AS quota_cpu, u.quota_memory
       FROM wl_user u LEFT JOIN supplier s ON u.username = 'user-' || s.s_suppkey::VARCHAR""",
    "wl_user",
)
def user_update(v):
    """New settings for some users; empty texts and NULLs keep the old value."""
    updates = v.table("supplier").select(
        F.concat(F.lit("user-"), F.col("s_suppkey").cast("string")).alias("username"),
        F.lit("").alias("role"),
        F.lit("advanced").alias("user_level"),
        F.col("s_nationkey").cast("int").alias("quota_pods"),
        F.when(F.col("s_acctbal") > 0, "2000m").otherwise("").alias("quota_cpu"),
        F.lit(None).cast("string").alias("quota_memory"),
    )
    return ops.update_users(v.users(), updates).select("username", *ops.USER_FIELDS)


@query(
    "seed_defaults",
    """SELECT workload_name, deploy_method, created_by FROM wl_type UNION ALL
       SELECT lower(p_brand), arg_min(CASE WHEN p_size < 25 THEN 'yaml' ELSE 'helm' END, p_partkey), 'admin'
       FROM part WHERE lower(p_brand) NOT IN (SELECT workload_name FROM wl_type) GROUP BY lower(p_brand)""",
    "wl_type",
)
def seed_defaults(v):
    """Default types named after brands; a name that exists is left alone."""
    columns = ["workload_name", "deploy_method", "created_by"]
    defaults = v.table("part").select(
        F.lower("p_brand").alias("workload_name"),
        F.when(F.col("p_size") < 25, "yaml").otherwise("helm").alias("deploy_method"),
        F.lit("admin").alias("created_by"),
        "p_partkey",
    )
    return ops.seed(v.types().select(*columns), defaults, "workload_name", "p_partkey")


@query(
    "wl_redeploy_spec",
    """SELECT workload_id, deploy_method, workload_name AS type, duration,
       CASE WHEN deploy_method = 'yaml' THEN coalesce(replicas::VARCHAR, '') ELSE '' END AS replicas,
       CASE WHEN deploy_method = 'yaml' THEN coalesce(node_name, '') ELSE '' END AS node_name,
       CASE WHEN deploy_method <> 'yaml' THEN helm_repo_name ELSE '' END AS repo_name,
       CASE WHEN deploy_method <> 'yaml' THEN helm_repo_url ELSE '' END AS repo_url,
       CASE WHEN deploy_method <> 'yaml' THEN helm_chart ELSE '' END AS chart_name,
       CASE WHEN deploy_method <> 'yaml' THEN helm_chart_version ELSE '' END AS chart_version,
       CASE WHEN deploy_method <> 'yaml' THEN helm_set_values ELSE '' END AS set_values FROM wl_list""",
    "wl_list",
)
def wl_redeploy_spec(v):
    spec = ops.redeploy_spec(_listing(v, "user-0", "admin"))
    blank = [
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        for c in ("replicas", "node_name", "repo_name", "repo_url", "chart_name", "chart_version", "set_values")
    ]
    return spec.select("workload_id", "deploy_method", "type", "duration", *blank)


@query(
    "wl_insert",
    """WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer),
       top AS (SELECT max(workload_id) AS wid FROM wl_deployed), ytop AS (SELECT max(id) AS yid FROM wl_yaml)
       SELECT workload_id, username, duration, CASE WHEN workload_id % 3 = 0 THEN workload_id ELSE -1 END AS yaml_id,
         coalesce(is_completed::VARCHAR, '') AS is_completed FROM wl_deployed
       UNION ALL SELECT wid + rn, 'user-' || c_custkey::VARCHAR, 60, yid + rn, 'false' FROM n, top, ytop""",
    "wl_deployed",
    "wl_yaml",
)
def wl_insert(v):
    """Every customer deploys one workload more."""
    key = F.col("c_custkey")
    new = v.table("customer").select(
        F.concat(F.lit("user-"), key.cast("string")).alias("username"),
        F.lit("type-1").alias("workload_name"),
        F.lit(60).alias("duration"),
        F.timestamp_seconds(F.lit(ASOF)).alias("created_at"),
        F.lit(None).cast("int").alias("replicas"),
        F.lit(None).cast("string").alias("node_name"),
        "c_custkey",
    )
    deployed, _ = ops.insert_workloads(
        v.deployed(), v.yaml(), new, "yaml", ["replicas", "node_name"], ["c_custkey"]
    )
    return deployed.select(
        "workload_id",
        "username",
        "duration",
        F.coalesce("yaml_workload_id", F.lit(-1)).alias("yaml_id"),
        F.coalesce(F.col("is_completed").cast("string"), F.lit("")).alias("is_completed"),
    )


@query(
    "helm_release_settings",
    """WITH deployments AS (
         SELECT o_orderkey AS id, 'release-' || o_orderkey::VARCHAR AS release_name,
           CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN '["base.yaml"]'
             ELSE '["base.yaml","zone-' || (o_orderkey % 5)::VARCHAR || '.yaml"]' END AS values_files,
           CASE WHEN o_orderkey % 7 = 0 THEN '{"replicas":' WHEN o_orderkey % 7 = 1 THEN NULL
             ELSE '{"replicas":"' || (o_orderkey % 9)::VARCHAR || '","image.tag":"v' || (o_orderkey % 11)::VARCHAR || '"}' END AS set_values
         FROM orders WHERE o_orderkey % 3 = 1
       ), named AS (
         SELECT *, unnest(json_keys(CASE WHEN json_valid(set_values) THEN set_values END)) AS name FROM deployments
       )
       SELECT id, release_name, coalesce(json_array_length(values_files), 0)::BIGINT AS files, name,
         json_extract_string(set_values, '$."' || name || '"') AS value FROM named""",
)
def helm_release_settings(v):
    """Settings of chart deployments, kept as JSON texts of which some are absent and some damaged."""
    key = F.col("o_orderkey")
    number = lambda m: (key % m).cast("string")
    files = (
        F.when(key % 4 == 1, "[]")
        .when(key % 4 == 2, '["base.yaml"]')
        .when(key % 4 == 3, F.concat(F.lit('["base.yaml","zone-'), number(5), F.lit('.yaml"]')))
    )
    pairs = F.concat(F.lit('{"replicas":"'), number(9), F.lit('","image.tag":"v'), number(11), F.lit('"}'))
    deployments = v.table("orders").filter(key % 3 == 1).select(
        key.alias("id"),
        F.concat(F.lit("release-"), key.cast("string")).alias("release_name"),
        files.alias("values_files"),
        F.when(key % 7 == 0, '{"replicas":').when(key % 7 != 1, pairs).alias("set_values"),
    )
    return ops.release_settings(deployments)
