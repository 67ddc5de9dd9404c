"""Catalogue of users, workload types and deployed workloads: listings and table changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from .numbering import sequential_ids

TYPE_COLUMNS = (
    "deploy_method",
    "helm_repo_name",
    "helm_repo_url",
    "helm_chart",
    "helm_chart_version",
    "helm_set_values",
)
ADMIN = "admin"


def visible_to(df: DataFrame, viewer: str, role: str) -> DataFrame:
    """An admin sees every row, a user the own ones."""
    return df if role == ADMIN else df.filter(F.col("username") == viewer)


def templates(types: DataFrame, viewer: str, role: str) -> DataFrame:
    """Enabled workload types: all for an admin, own and the admin's for a user."""
    enabled = types.filter(F.col("workload_enabled"))
    if role != ADMIN:
        enabled = enabled.filter(F.col("created_by").isin(viewer, ADMIN))
    return enabled.select("workload_name", *TYPE_COLUMNS)


def with_type(deployed: DataFrame, types: DataFrame) -> DataFrame:
    """Attach the type of each workload.

    Types are keyed by name and creator but workloads reference the name only: the row of
    the workload's owner is preferred, then the admin's, then the first creator by name.
    """
    fields = F.struct(*[F.col(c) for c in TYPE_COLUMNS])
    own = types.select(
        F.col("workload_name").alias("_own_name"),
        F.col("created_by").alias("_own_user"),
        fields.alias("_own"),
    )
    preference = F.struct(F.col("created_by") != ADMIN, F.col("created_by"))
    shared = types.groupBy(F.col("workload_name").alias("_name")).agg(
        F.min_by(fields, preference).alias("_shared")
    )
    chosen = F.coalesce(F.col("_own"), F.col("_shared"))
    return (
        deployed.join(shared, F.col("workload_name") == F.col("_name"))
        .join(
            own,
            (F.col("workload_name") == F.col("_own_name")) & (F.col("username") == F.col("_own_user")),
            "left",
        )
        .withColumn("_type", chosen)
        .select(*deployed.columns, *[F.col(f"_type.{c}").alias(c) for c in TYPE_COLUMNS])
    )


def with_details(deployed: DataFrame, yaml: DataFrame, helm: DataFrame) -> DataFrame:
    """Attach the yaml or helm detail; a workload with neither is left out, yaml wins over helm.

    An id that points nowhere counts as none: the other detail holds then. A workload without an id
    of a kind gets the other id as a key that no detail has, so such rows spread over the tasks.
    """
    ids = ("yaml_workload_id", "helm_workload_id")
    deployed = deployed.filter(F.coalesce(*ids).isNotNull())
    for kind, table, names in (
        ("yaml", yaml, ("replicas", "node_name")),
        ("helm", helm, ("chart_name", "chart_version", "set_values")),
    ):
        own, key, salt = f"{kind}_workload_id", f"_{kind}_key", f"_{kind}_salt"
        detail = table.select(
            F.col("id").alias(key), F.lit(0).alias(salt), F.struct(*names).alias(f"_{kind}")
        )
        deployed = deployed.withColumns(
            {
                key: F.coalesce(own, *ids),
                salt: F.when(F.col(own).isNull(), 1).otherwise(0),
            }
        ).join(detail, [key, salt], "left").drop(key, salt)
    by_yaml = F.col("_yaml").isNotNull()
    found = deployed.filter(by_yaml | F.col("_helm").isNotNull())
    return found.select(
        *[c for c in deployed.columns if c not in ("_yaml", "_helm")],
        "_yaml.replicas",
        "_yaml.node_name",
        *[
            F.when(~by_yaml, F.col(f"_helm.{c}")).alias(c)
            for c in ("chart_name", "chart_version", "set_values")
        ],
    )


def listing(
    deployed: DataFrame,
    yaml: DataFrame,
    helm: DataFrame,
    types: DataFrame,
    users: DataFrame,
    viewer: str,
    role: str = "user",
) -> DataFrame:
    """Deployed workloads a viewer may see, with type and detail columns."""
    rows = visible_to(deployed, viewer, role).join(
        users.select("username"), "username", "left_semi"
    )
    return with_type(with_details(rows, yaml, helm), types)


def running(deployed: DataFrame, types: DataFrame, viewer: str, role: str = "user") -> DataFrame:
    """Workloads known not to be completed; an unknown state does not count as running."""
    rows = visible_to(deployed, viewer, role).filter(F.col("is_completed").eqNullSafe(False))
    return with_type(rows, types).select(
        "workload_id",
        "deploy_method",
        "workload_name",
        "duration",
        "is_completed",
        "username",
        "created_at",
    )


def display(rows: DataFrame, created_text: str = "created_text") -> DataFrame:
    """Listing as shown: status words, blanks, and only the columns of the deploy method."""

    def shown(method: str, column: str) -> Column:
        value = text.blank_if_null(F.col(column).cast("string"))
        return F.when(F.col("deploy_method") == method, value).otherwise(F.lit("")).alias(column)

    return rows.select(
        "workload_id",
        "workload_name",
        "username",
        "deploy_method",
        text.cut_fraction(F.col(created_text)).alias("created_at"),
        "duration",
        shown("yaml", "replicas"),
        shown("yaml", "node_name"),
        shown("helm", "chart_name"),
        shown("helm", "chart_version"),
        shown("helm", "set_values"),
        F.when(F.col("is_completed").eqNullSafe(True), F.lit("Finished"))
        .otherwise(F.lit("Running"))
        .alias("status"),
    )


def lookup(df: DataFrame, **key: object) -> DataFrame:
    """Rows with exactly this (composite) key; an unknown key gives an empty frame."""
    for column, value in key.items():
        df = df.filter(F.col(column) == value)
    return df


def redeploy_spec(rows: DataFrame, workload_id: int | None = None) -> DataFrame:
    """Parameters to deploy a past workload again.

    A yaml workload repeats its own replicas and node, a helm workload takes the chart
    fields of its type as they are now.
    """
    if workload_id is not None:
        rows = lookup(rows, workload_id=workload_id)
    is_yaml = F.col("deploy_method") == "yaml"

    def by_method(column: str, alias: str, yaml: bool) -> Column:
        return F.when(is_yaml if yaml else ~is_yaml, F.col(column)).alias(alias)

    return rows.select(
        "workload_id",
        "deploy_method",
        F.col("workload_name").alias("type"),
        "duration",
        by_method("replicas", "replicas", True),
        by_method("node_name", "node_name", True),
        by_method("helm_repo_name", "repo_name", False),
        by_method("helm_repo_url", "repo_url", False),
        by_method("helm_chart", "chart_name", False),
        by_method("helm_chart_version", "chart_version", False),
        by_method("helm_set_values", "set_values", False),
    )


def next_id(table: DataFrame, column: str) -> int:
    """One past the highest id."""
    highest = table.agg(F.max(column)).first()[0]
    return 1 if highest is None else int(highest) + 1


def insert_workloads(
    deployed: DataFrame,
    details: DataFrame,
    new: DataFrame,
    method: str,
    detail_columns: Sequence[str],
    order: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """Add new workloads and their linked detail rows; returns (deployed, details).

    ``new`` has username, workload_name, duration, created_at and the detail columns. Ids
    continue those of the tables. Defaults: one replica, node ``any``, status ``success``,
    not completed, finished_at as created_at.
    """
    defaults = {"replicas": F.lit(1), "node_name": F.lit("any")}
    filled = new.withColumns(
        {c: F.coalesce(F.col(c), d) for c, d in defaults.items() if c in detail_columns}
    )
    numbered = sequential_ids(filled, order, "_n", start=0)
    detail_start, deployed_start = next_id(details, "id"), next_id(deployed, "workload_id")
    detail_id = F.col("_n") + detail_start
    new_details = numbered.select(detail_id.alias("id"), *detail_columns)
    links = {f"{m}_workload_id": F.lit(None).cast("bigint") for m in ("yaml", "helm")}
    links[f"{method}_workload_id"] = detail_id
    new_rows = numbered.select(
        (F.col("_n") + deployed_start).alias("workload_id"),
        "username",
        "workload_name",
        F.col("duration").cast("int").alias("duration"),
        F.lit("success").alias("deployment_status"),
        F.lit(False).alias("is_completed"),
        "created_at",
        F.col("created_at").alias("finished_at"),
        *[c.alias(n) for n, c in links.items()],
    )
    return (
        deployed.unionByName(new_rows, allowMissingColumns=True),
        details.unionByName(new_details, allowMissingColumns=True),
    )


def complete(deployed: DataFrame, workload_id: int, asof: Column) -> DataFrame:
    """Mark one workload completed at ``asof``, only if it is still running."""
    return _finish(deployed, F.col("workload_id") == workload_id, asof)


def expire(deployed: DataFrame, asof: Column) -> DataFrame:
    """Complete running workloads whose duration has passed; they finish when it passed."""
    ends = F.timestamp_seconds(
        F.unix_timestamp("created_at") + F.col("duration").cast("bigint")
    )
    return _finish(deployed, ends <= asof, ends)


def _finish(deployed: DataFrame, which: Column, at: Column) -> DataFrame:
    due = which & F.col("is_completed").eqNullSafe(False)
    return deployed.withColumns(
        {
            "finished_at": F.when(due, at).otherwise(F.col("finished_at")),
            "is_completed": F.when(due, F.lit(True)).otherwise(F.col("is_completed")),
        }
    )


USER_FIELDS = ("role", "user_level", "quota_pods", "quota_cpu", "quota_memory")


def update_users(users: DataFrame, updates: DataFrame) -> DataFrame:
    """Overwrite user fields by name; an empty or absent new value keeps the old one."""
    renamed = updates.select("username", *[F.col(c).alias(f"_new_{c}") for c in USER_FIELDS])

    def new_value(column: str) -> Column:
        given = F.nullif(F.col(f"_new_{column}").cast("string"), F.lit(""))
        return F.coalesce(given.cast(users.schema[column].dataType), F.col(column))

    joined = users.join(renamed, "username", "left")
    return joined.withColumns({c: new_value(c) for c in USER_FIELDS}).select(*users.columns)


def seed(existing: DataFrame, defaults: DataFrame, key: str, order: str) -> DataFrame:
    """Add default rows whose key is not there yet; of equal defaults the first by ``order``."""
    others = [c for c in defaults.columns if c != key]
    first = (
        defaults.groupBy(key)
        .agg(F.min_by(F.struct(*[F.col(c) for c in others]), order).alias("_row"))
        .select(key, *[F.col(f"_row.{c}").alias(c) for c in others])
    )
    absent = first.join(existing.select(key), key, "left_anti")
    return existing.unionByName(absent.select(*existing.columns))


def read_release(deployments: DataFrame) -> DataFrame:
    """Chart deployments with the texts of their settings opened: ``values_files`` a list, ``set_values`` pairs by name.

    Both are JSON texts, a list of file names and an object. An absent text, or one that is not JSON of that kind,
    is NULL; a value that is not a text is kept as its JSON.
    """
    opened = {"values_files": "array<string>", "set_values": "map<string,string>"}
    return deployments.withColumns({c: F.from_json(c, F.lit(kind)) for c, kind in opened.items()})


def write_release(deployments: DataFrame) -> DataFrame:
    """``read_release`` undone: lists and pairs as JSON texts, pairs in order of their names."""
    names = F.array_sort(F.map_keys("set_values"))
    sorted_pairs = F.map_from_arrays(names, F.transform(names, lambda n: F.element_at("set_values", n)))
    return deployments.withColumns({"values_files": F.to_json("values_files"), "set_values": F.to_json(sorted_pairs)})


def release_settings(deployments: DataFrame) -> DataFrame:
    """One row per setting of a deployment: ``id``, ``release_name``, ``name``, ``value``, and how many files it has.

    Deployments without readable pairs have no row.
    """
    opened = read_release(deployments)
    return opened.select(
        "id",
        "release_name",
        F.coalesce(F.size("values_files"), F.lit(0)).cast("bigint").alias("files"),
        F.explode("set_values").alias("name", "value"),
    )


_WHOLE = ("tinyint", "smallint", "int", "bigint")
_FIXED = (*_WHOLE, "boolean", "float", "double", "date", "timestamp", "timestamp_ntz")


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write per key; of writes that agree in ``order`` one.

    Leading times and whole numbers of the order are ranked by hash aggregation, which reduces a hot key
    before the shuffle. If nothing else is left to compare and all columns have a fixed width, that
    aggregation has the rows already. Otherwise the rows that have their key's highest rank are looked up, by
    a broadcast where the keys are few, and only these are compared by the rest of the order.
    """
    kinds, times = dict(df.dtypes), ("timestamp", "timestamp_ntz")
    first = []
    for c in order[:2]:
        if kinds[c] not in (*_WHOLE, *times):
            break
        first.append(F.unix_micros(F.col(c).cast("timestamp")) if kinds[c] in times else F.col(c))
    others = [c for c in df.columns if c not in keys]
    if not first:
        newest = F.max_by(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in order]))
        found = df.groupBy(*keys).agg(newest.alias("_row"))
        return found.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
    rank = rules.rank(*first)
    if len(first) == len(order) and all(kinds[c] in _FIXED for c in others):
        # All of them follow the same rank over the same rows, so they come from one row.
        return df.groupBy(*keys).agg(*[F.max_by(c, rank).alias(c) for c in others]).select(*df.columns)
    ranked = df.withColumn("_rank", rank)
    best = ranked.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max("_rank").alias("_k_rank"))
    same = F.col("_rank") == F.col("_k_rank")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    place = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    tied = ranked.join(best, same, "left_semi").withColumn("_place", F.row_number().over(place))
    return tied.filter(F.col("_place") == 1).select(*df.columns)
