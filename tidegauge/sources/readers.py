"""Batch and streaming readers with declared schemas; nothing infers types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from . import snapshots, writers

METRIC_LABELS = ("host", "container_name", "pod_name")


def value_file(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``int,float`` lines."""
    return (
        spark.read.schema(schemas.VALUE_FILE)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )


def metric_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = ("timestamp", "value", *METRIC_LABELS),
) -> DataFrame:
    """Metric export with a header; header rows repeated by appending are dropped.

    ``columns`` is the layout of the files; Spark checks it against each header. Labels an
    export does not have are NULL.
    """
    layout = ", ".join(f"`{c}` STRING" for c in columns)
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(layout).csv(path)
    return typed_metrics(raw)


def typed_metrics(raw: DataFrame) -> DataFrame:
    """Type metric rows read as text; repeated header rows have no number as time and go."""
    labels = [
        F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in METRIC_LABELS
    ]
    typed = raw.select(
        text.to_bigint(F.col("timestamp")).alias("timestamp"),
        text.to_double(F.col("value")).alias("value"),
        *labels,
    )
    return typed.filter(F.col("timestamp").isNotNull())


def log_csv(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Log export: text timestamp, sensor, status. Without ``pattern`` ISO text is expected."""
    raw = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .schema("timestamp STRING, sensor STRING, status STRING")
        .csv(path)
    )
    return timed_logs(raw, pattern)


def timed_logs(raw: DataFrame, pattern: str | None = None) -> DataFrame:
    """Text times of log rows to TIMESTAMP; a text that is no time gives NULL."""
    at = F.try_to_timestamp("timestamp", F.lit(pattern)) if pattern else F.try_to_timestamp("timestamp")
    return raw.withColumn("timestamp", at)


def stored_csv(spark: SparkSession, path: str) -> DataFrame:
    """Readings written by the file store."""
    return spark.read.schema(schemas.READING).csv(path)


def stored_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def keyed_table(
    spark: SparkSession,
    path: str,
    keys: Sequence[str] = ("readingTS",),
    first_day: str | None = None,
    last_day: str | None = None,
) -> DataFrame:
    """Current rows of a keyed store: the last write per key over all batches.

    Only folders of the current version and of days in the range are listed, and a key lies in one day.
    """
    rows = snapshots.read(spark, path, writers.KEYED_FILES, first_day, last_day)
    if first_day:
        rows = rows.filter(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day:
        rows = rows.filter(F.col("day") <= F.lit(last_day).cast("date"))
    return writers.last_writes(rows, keys).drop("batch_id")


def snapshot_table(
    spark: SparkSession, path: str, schema: str, first_day: str | None = None, last_day: str | None = None
) -> DataFrame:
    """The current version of a table that is replaced or merged as a whole; no table has no rows.

    ``schema`` has ``day`` as its last column if the table is by day.
    """
    return snapshots.read(spark, path, schema, first_day, last_day)


def relational_table(
    spark: SparkSession, url: str, table: str, partition_column: str | None = None, **options: str
) -> DataFrame:
    """Table of a relational store over JDBC; the driver jar comes with the cluster.

    Filters and columns are pushed into the database. Give ``partition_column`` with
    lowerBound, upperBound and numPartitions to read in parallel.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column:
        reader = reader.option("partitionColumn", partition_column)
    return reader.load()


def pod_inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.POD_INVENTORY).json(path)


def node_inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.NODE_INVENTORY).json(path)


def catalogue_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the catalogue tables, stored as parquet under ``root``, or as versions by ``update_catalogue``."""
    if snapshots.current(spark, f"{root}/{name}")[0]:
        return snapshots.read(spark, f"{root}/{name}", schemas.CATALOGUE[name])
    return spark.read.schema(schemas.CATALOGUE[name]).parquet(f"{root}/{name}")


def text_stream(
    spark: SparkSession, path: str, max_files: int | None = None
) -> DataFrame:
    """Stream of text payloads, one per line of the files arriving in a folder."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def topic_stream(
    spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None, **options: str
) -> DataFrame:
    """Stream of a Kafka topic as text key and value.

    Starts at the earliest record; afterwards the checkpoint of the query keeps the
    position. Needs the Kafka connector of Spark on the cluster.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**options)
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")
    )
