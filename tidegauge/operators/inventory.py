"""Pods, nodes and agent settings as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

CONTROL_PLANE = "node-role.kubernetes.io/control-plane"

# What the metric agent collects.
AGENT_FIELDS = {
    "cpu": (
        "usage_user", "usage_system", "usage_idle", "usage_active", "usage_nice", "usage_iowait",
        "usage_irq", "usage_softirq", "usage_steal", "usage_guest", "usage_guest_nice",
    ),
    "disk": ("free", "used", "total", "used_percent"),
    "diskio": ("read_time", "write_time", "reads", "writes", "io_time"),
    "mem": ("available", "free", "total", "used_percent"),
    "system": ("load1", "load5", "load15"),
}
IGNORED_FILESYSTEMS = (
    "tmpfs", "devtmpfs", "devfs", "iso9660", "overlay", "aufs", "squashfs", "loop*"
)
DISKS = ("sda", "sdb", "sdc", "vda")
INTERFACES = ("eth*", "ens*", "eno*")
POD_MEASUREMENTS = ("kubernetes_pod_container", "kubernetes_pod_volume", "kubernetes_pod_network")


def pod_labels(pods: DataFrame, prefix: str = "workload_id") -> DataFrame:
    """Keep labels whose key starts with ``prefix`` under metric-safe names; skip pods without."""
    kept = F.map_filter("labels", lambda key, _: F.startswith(key, F.lit(prefix)))
    safe = F.transform_keys(
        "_kept", lambda key, _: F.concat(F.lit("label_"), F.translate(key, "-.", "__"))
    )
    return (
        pods.withColumn("_kept", kept)
        .filter(F.size("_kept") > 0)
        .withColumn("labels", safe)
        .drop("_kept")
    )


def ready_nodes(nodes: DataFrame, require_ready: bool = True) -> DataFrame:
    """Host names of worker nodes, by default of the ready ones only."""
    on_control_plane = F.coalesce(F.map_contains_key("labels", CONTROL_PLANE), F.lit(False))
    wanted = nodes.filter(~on_control_plane)
    if require_ready:
        wanted = wanted.filter(
            F.exists("conditions", lambda c: (c["type"] == "Ready") & (c["status"] == "True"))
        )
    names = F.filter("addresses", lambda a: a["type"] == "Hostname")
    return wanted.select(F.explode(names).alias("_a")).select(F.col("_a.address").alias("node"))


def allowed_fields(
    df: DataFrame,
    fields: dict[str, Sequence[str]] = AGENT_FIELDS,
    ignored_filesystems: Sequence[str] = IGNORED_FILESYSTEMS,
    disks: Sequence[str] = DISKS,
    interfaces: Sequence[str] = INTERFACES,
    pod_measurements: Sequence[str] = POD_MEASUREMENTS,
) -> DataFrame:
    """Collected samples that pass the agent's lists.

    Columns: measurement, field, fstype, device. ``fields`` names the fields kept per
    measurement; a measurement without an entry keeps all. Names may use ``*``.
    """
    measurement = F.col("measurement")
    keep = F.lit(True)
    for name, kept in fields.items():
        keep = keep & ((measurement != name) | F.col("field").isin(list(kept)))
    return df.filter(
        keep
        & ((measurement != "disk") | ~text.glob_any(F.col("fstype"), ignored_filesystems))
        & ((measurement != "diskio") | text.glob_any(F.col("device"), disks))
        & ((measurement != "net") | text.glob_any(F.col("device"), interfaces))
        & (~measurement.startswith("kubernetes_") | measurement.isin(list(pod_measurements)))
    )
