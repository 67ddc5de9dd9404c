"""Stores for readings, actions and generated values.

A store is a function ``(readings, table, batch_id) -> None``. Every write is idempotent per
batch id: a batch that is replayed after a failure replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .. import schemas
from ..operators.catalogue import latest_by_key
from ..operators.numbering import sequential_ids
from . import snapshots

Store = Callable[[DataFrame, str, int], None]

READING_COLUMNS = ("reading_ts", "process_ts", "sensor", "temperature", "humidity")
TABLES = (schemas.VALID_TABLE, schemas.INVALID_TABLE)


def batch_folder(root: str, table: str, batch_id: int) -> str:
    return f"{root}/{table}/batch_id={batch_id}"


def _exists(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        # Only a missing folder is an empty table; anything else must not let rows be replaced.
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def clear(
    spark: SparkSession,
    root: str,
    tables: Sequence[str] = TABLES,
    partition: str = "batch_id",
) -> None:
    """Empty the tables of a store, as at a fresh start. Never done implicitly.

    A table of versions gets an empty one; its readers go on with theirs.
    """
    versioned = [t for t in tables if snapshots.current(spark, f"{root}/{t}")[0]]
    for table in versioned:
        snapshots.commit(spark, f"{root}/{table}", lambda _: [])
    tables = [t for t in tables if t not in versioned]
    nothing = spark.createDataFrame([], f"value STRING, {partition} STRING")
    for table in (*tables, *[f"_last_id/{t}" for t in tables]):
        nothing.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
            partition
        ).text(f"{root}/{table}")


def file_store(root: str) -> Store:
    """Headerless CSV lines per table."""

    def write(readings: DataFrame, table: str, batch_id: int) -> None:
        folder = batch_folder(root, table, batch_id)
        readings.select(*READING_COLUMNS).write.mode("overwrite").csv(folder)

    return write


def _stored_form(readings: DataFrame) -> DataFrame:
    return readings.select(
        F.col("reading_ts").cast("string").alias("readingTS"),
        F.col("process_ts").cast("string").alias("processTS"),
        F.col("sensor").alias("sensorID"),
        "temperature",
        F.col("humidity").cast("float").alias("humidity"),
    )


def _last_id(spark: SparkSession, root: str, table: str, batch_id: int) -> int:
    """Highest id before ``batch_id``, from the note of the batch before it.

    Only after a gap in the batch ids are the ids of the table scanned.
    """
    note = _exists(spark, batch_folder(f"{root}/_last_id", table, batch_id - 1), "last BIGINT")
    if note is not None:
        return note.first().last
    stored = _exists(spark, f"{root}/{table}", f"{schemas.READING_STORE}, batch_id BIGINT")
    if stored is None:
        return 0
    return stored.filter(F.col("batch_id") < batch_id).agg(F.max("id")).first()[0] or 0


def relational_store(root: str) -> Store:
    """Append with a surrogate id, kept as parquet by day; ids continue after earlier batches.

    Beside the text of the reading time its second is kept as a number, ``reading_s``, so that
    ``readings.recent`` prunes days and row groups.
    """

    def write(readings: DataFrame, table: str, batch_id: int) -> None:
        spark = readings.sparkSession
        last = _last_id(spark, root, table, batch_id)
        order = ["readingTS", "sensorID", "processTS", "temperature", "humidity"]
        numbered = sequential_ids(_stored_form(readings), order, "id", last + 1)
        dated = numbered.withColumn("reading_s", F.col("readingTS").try_cast("bigint")).withColumn(
            "day", F.to_date(F.timestamp_seconds("reading_s"))
        )
        # The folder belongs to this batch: replace all of its days, also after a replay.
        dated.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
            "day"
        ).parquet(batch_folder(root, table, batch_id))
        note = numbered.agg(F.coalesce(F.max("id"), F.lit(last)).alias("last"))
        note.write.mode("overwrite").parquet(batch_folder(f"{root}/_last_id", table, batch_id))

    return write


def jdbc_store(url: str, **options: str) -> Store:
    """Append to a database table that numbers its rows itself.

    A database append is at-least-once: replaying a batch repeats its rows unless the table
    has a unique key.
    """

    def write(readings: DataFrame, table: str, batch_id: int) -> None:
        _stored_form(readings).write.format("jdbc").option("url", url).option(
            "dbtable", table
        ).options(**options).mode("append").save()

    return write


#: Columns of a keyed table as its files have them. A batch says nothing about its rows but their order.
KEYED_FILES = f"{schemas.READING_KEYED}, batch_id BIGINT, day DATE"


def keyed_store(root: str, keys: Sequence[str] = ("readingTS",)) -> Store:
    """Keyed table, last write wins; ``readers.keyed_table`` reads it.

    A batch only adds folders of its own, by day, with one row per key, and switches the table's version
    (``snapshots``). Which write is the last is settled when the table is read: a batch never rewrites the days it
    touches, so its cost does not grow with the table. ``compact_keyed`` folds the folders of a day together.

    With the default key, readings of the same second replace each other;
    ``("readingTS", "sensorID")`` keeps one per sensor.
    """

    def write(readings: DataFrame, table: str, batch_id: int) -> None:
        rows = readings.select(
            F.timestamp_seconds("reading_ts").alias("readingTS"),
            F.timestamp_seconds("process_ts").alias("processTS"),
            F.col("sensor").alias("sensorID"),
            "temperature",
            F.col("humidity").cast("float").alias("humidity"),
            F.lit(batch_id).cast("bigint").alias("batch_id"),
        ).withColumn("day", F.to_date("readingTS"))
        snapshots.append(latest_by_key(rows, list(keys), list(schemas.KEYED_ORDER)), f"{root}/{table}", batch_id)

    return write


def last_writes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a keyed table's files to its current rows."""
    first, *ties = schemas.KEYED_ORDER
    return latest_by_key(rows, list(keys), [first, "batch_id", *ties])


def compact_keyed(spark: SparkSession, path: str, keys: Sequence[str] = ("readingTS",), least: int = 2) -> int:
    """Fold the folders of every day of a keyed table that has ``least`` of them; returns how many days.

    May run beside the stream that fills the table, and may fail at any point: readers see the folders from before
    until the folded ones are whole.
    """
    return snapshots.compact(spark, path, KEYED_FILES, lambda rows: last_writes(rows, keys), least)


def merge(
    spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> None:
    """Merge ``rows`` into the table of versions at ``path``, last write per key wins.

    Both are by ``day``, which must follow from the key. Only days that ``rows`` touch are read, and their
    folders are exchanged for the merged ones in one switch. ``readers.snapshot_table`` reads the table.
    Repeating a merge changes nothing.
    """
    columns = [c for c in rows.columns if c != "day"]
    rows = rows.select(*columns, "day")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    days = {str(r["day"]) for r in rows.select("day").distinct().collect()}  # a row per day
    touched = [f for f in snapshots.current(spark, path)[1] if f.day in days]

    def merged(stored: DataFrame) -> DataFrame:
        return latest_by_key(stored.select(*rows.columns).unionByName(rows), keys, order)

    snapshots.rewrite(spark, path, schema, touched, merged)


def no_store() -> Store:
    """Readings are not kept; actions still go out."""

    def write(readings: DataFrame, table: str, batch_id: int) -> None:
        return None

    return write


STORES: dict[str, Callable[..., Store]] = {
    "cassandra": keyed_store,
    "keyed": keyed_store,
    "mysql": relational_store,
    "relational": relational_store,
    "jdbc": jdbc_store,
    "file": file_store,
}


def get_store(name: str, *args: str, **options) -> Store:
    """Store by name; any other name keeps nothing."""
    factory = STORES.get(name)
    return factory(*args, **options) if factory else no_store()


def dead_files(root: str, table: str) -> Callable[[DataFrame, int], None]:
    """Dead letters as JSON lines with the raw ``value`` and the reason ``error``."""

    def write(letters: DataFrame, batch_id: int) -> None:
        letters.select("value", "error").write.mode("overwrite").json(batch_folder(root, table, batch_id))

    return write


def topic_files(root: str, table: str) -> Callable[[DataFrame, int], None]:
    """Text records of a topic as files, one folder per batch."""

    def write(records: DataFrame, batch_id: int) -> None:
        records.select("value").write.mode("overwrite").text(batch_folder(root, table, batch_id))

    return write


def topic(servers: str, name: str, **options: str) -> Callable[[DataFrame, int], None]:
    """Kafka topic sink for frames with ``value`` and optionally ``key``."""

    def write(records: DataFrame, batch_id: int) -> None:
        columns = [F.col(c).cast("binary").alias(c) for c in ("key", "value") if c in records.columns]
        records.select(*columns).write.format("kafka").option(
            "kafka.bootstrap.servers", servers
        ).option("topic", name).options(**options).save()

    return write


def save_values(values: DataFrame, root: str) -> None:
    """Generated values as headerless CSV, one folder per class, in one pass."""
    values.select("class", "temperature", "humidity").write.mode("overwrite").partitionBy(
        "class"
    ).csv(root)


def save_sorted(values: DataFrame, path: str, server: str, client: str, algorithm: str) -> None:
    """Values in ascending order with consecutive ids; input columns ``value`` and ``tie``.

    Readers (``readers.snapshot_table``) see the values from before until the new ones are whole.
    """
    numbered = sequential_ids(values, ["value", "tie"]).select(
        "id",
        F.lit(server).alias("server"),
        F.lit(client).alias("client"),
        F.lit(algorithm).alias("algorithm"),
        F.col("value").cast("bigint").alias("value"),
    )
    snapshots.replace(numbered, path)


def replace_snapshot(snapshot: DataFrame, path: str) -> None:
    """Replace the current series set; what is not in the snapshot is gone.

    Readers (``readers.snapshot_table``) see the set from before until the new one is whole.
    """
    snapshots.replace(snapshot, path)


def update_catalogue(
    spark: SparkSession, root: str, name: str, change: Callable[[DataFrame], DataFrame]
) -> None:
    """Write a catalogue table back after ``change``, one of the operators of ``catalogue``, in one switch.

    Raises ``snapshots.Conflict`` if the table changed meanwhile, and leaves it as it is.
    """
    snapshots.update(spark, f"{root}/{name}", schemas.CATALOGUE[name], change)


def append_export(metrics: DataFrame, path: str) -> None:
    """Append a metric export; every part has a header, which the reader drops."""
    metrics.write.mode("append").option("header", True).csv(path)
