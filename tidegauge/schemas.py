"""Fixed schemas of every input and stored table, as DDL."""

VALUE_FILE = "temperature INT, humidity DOUBLE"
TELEMETRY_TEXT = "value STRING"
TOPIC_RECORD = "key STRING, value STRING"
# All four fields of a topic value are text; typing happens in the analyzer.
TOPIC_VALUE = "measurement_ts STRING, temperature STRING, humidity STRING, sensor STRING"
READING = "reading_ts BIGINT, process_ts BIGINT, sensor STRING, temperature INT, humidity DOUBLE"
READING_STORE = (
    "id BIGINT, readingTS STRING, processTS STRING, sensorID STRING, temperature INT, humidity FLOAT"
)
READING_KEYED = (
    "readingTS TIMESTAMP, processTS TIMESTAMP, sensorID STRING, temperature INT, humidity FLOAT"
)
# Which of two keyed readings is the later write.
KEYED_ORDER = ("processTS", "sensorID", "temperature", "humidity")
METRIC_CSV = "timestamp BIGINT, value DOUBLE, host STRING, container_name STRING, pod_name STRING"
LOG_CSV = "timestamp TIMESTAMP, sensor STRING, status STRING"
SERIES = (
    "ts BIGINT, namespace STRING, host STRING, pod_name STRING, container_name STRING, value DOUBLE"
)
LOG_STREAM = "ts TIMESTAMP, namespace STRING, workload_id STRING, pod STRING, line STRING"
HEALTH = "ts BIGINT, instance STRING, job STRING, path STRING, up INT, disk_used_percent DOUBLE"
POD_INVENTORY = "namespace STRING, pod_name STRING, host STRING, labels MAP<STRING, STRING>"
NODE_INVENTORY = (
    "labels MAP<STRING, STRING>, "
    "conditions ARRAY<STRUCT<type: STRING, status: STRING>>, "
    "addresses ARRAY<STRUCT<type: STRING, address: STRING>>"
)
SORTED_VALUE = "id BIGINT, server STRING, client STRING, algorithm STRING, value BIGINT"

CATALOGUE = {
    "user": (
        "id BIGINT, username STRING, role STRING, user_level STRING, namespace STRING, "
        "quota_pods INT, quota_cpu STRING, quota_memory STRING"
    ),
    "workload_type": (
        "workload_name STRING, workload_enabled BOOLEAN, created_at TIMESTAMP, deploy_method STRING, "
        "helm_repo_name STRING, helm_repo_url STRING, helm_chart STRING, helm_chart_version STRING, "
        "helm_set_values STRING, created_by STRING"
    ),
    "yaml_workload": "id BIGINT, replicas INT, node_name STRING, yaml_file_path STRING",
    "helm_workload": "id BIGINT, chart_name STRING, chart_version STRING, set_values STRING",
    "deployed_workload": (
        "workload_id BIGINT, username STRING, workload_name STRING, duration INT, "
        "deployment_status STRING, is_completed BOOLEAN, created_at TIMESTAMP, finished_at TIMESTAMP, "
        "yaml_workload_id BIGINT, helm_workload_id BIGINT"
    ),
    "helm_deployment": (
        "id BIGINT, release_name STRING, chart STRING, version STRING, repo_url STRING, "
        "values_files STRING, set_values STRING, user_id BIGINT, created_at TIMESTAMP"
    ),
}

TOPIC_KEY = "server-room"
ACTUATOR_ID = "actuator-0"
VALID_TABLE = "temperature"
INVALID_TABLE = "temperature_invalid"
