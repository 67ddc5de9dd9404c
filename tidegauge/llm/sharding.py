"""Contiguous shards of nearly equal size from global prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import carried, running, table, written


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text plus one for its separator; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_by_bytes(
    rows: DataFrame, shards: int, order: list[str], size: str = "size"
) -> DataFrame:
    """Cut ``rows`` in the order of ``order`` into ``shards`` runs of nearly equal ``size``.

    Each partition of the ordered rows is summed by itself; the totals of earlier partitions turn
    its sums into global ones. With ``T`` the total, row ``r`` belongs to the shard whose equal
    target of ``T / shards`` holds the middle of ``r``. So a shard is off its target by less than one
    row, and shards are contiguous in the order. ``slot`` counts a shard's rows from 0.

    Adds ``shard`` (int) and ``slot`` (long). ``size`` must be positive and not null. Rows that
    agree in ``order`` may swap places. Nulls in ``order`` come first. Columns with the names added are replaced.
    No rows give no rows.
    """
    return carried(rows, [*order, size], ["shard", "slot"], lambda x: _shard_by_bytes(x, shards, order, size))


def _shard_by_bytes(rows: DataFrame, shards: int, order: list[str], size: str) -> DataFrame:
    kept = rows.columns
    placed = written(running(rows, order, {"before": size}))
    total = placed.agg(F.sum(size)).first()[0] or 1
    middle = (F.lit(2) * F.col("before") + F.col(size)).cast("decimal(38,0)") * shards
    cut = placed.withColumn("_wide", middle).withColumn(
        "shard", F.least(F.expr(f"_wide div cast({2 * total} as decimal(38,0))"), F.lit(shards - 1)).cast("int")
    )
    first = cut.groupBy("shard").agg(F.min("position").alias("_first"))
    numbered = cut.join(F.broadcast(first), "shard")  # at most `shards` rows
    return numbered.select(*kept, "shard", (F.col("position") - F.col("_first")).alias("slot"))


def op1_shard_bytes(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of nearly equal bytes, contiguous in doc_id."""
    sized = table(spark, sf_dir, "documents").select(
        "doc_id",
        text_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard_by_bytes(sized, 8, ["doc_id", "text_crc32", "size"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
