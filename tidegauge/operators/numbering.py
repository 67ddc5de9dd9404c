"""Row numbers without one task seeing a whole group.

``positions`` numbers rows inside groups by a unique integer sequence column;
``sequential_ids`` numbers a whole table in a total order. Both count first and add
offsets, so a group with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK_ROWS = 1 << 20


def positions(
    df: DataFrame,
    by: Sequence[str],
    seq: str,
    name: str = "pos",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add the 1-based position of each row in its ``by`` group, ordered by ``seq``.

    ``seq`` must be an integer that is unique within a group. Rows are cut into chunks
    ``seq div chunk_rows``; uniqueness bounds a (group, chunk) by ``chunk_rows`` rows
    whatever the skew. Chunk counts give the offset of each chunk: first among the chunks of
    a span of ``chunk_rows`` chunks, then among the spans of the group. So sparse ids, where a
    chunk may have one row, do not gather in one task either. The rows and their offsets
    meet on the key the window needs anyway, so rows shuffle once.
    """
    # A struct key equals itself also when a group column is NULL, so no group is lost.
    group = F.struct(*[F.col(c) for c in by])
    rows = df.withColumn(
        "_key", F.struct(group.alias("group"), F.expr(f"`{seq}` div {chunk_rows}").alias("chunk"))
    )
    counts = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows"))
    chunks = counts.select(
        "_key",
        F.struct(F.col("_key.group"), F.expr(f"_key.chunk div {chunk_rows}").alias("span")).alias("_span"),
        "_rows",
    )

    def before(part: str, order: str) -> Column:
        earlier = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_rows").over(earlier), F.lit(0))

    spans = chunks.groupBy("_span").agg(F.sum("_rows").alias("_rows"))
    spans = spans.select("_span", before("_span.group", "_span.span").alias("_spans_before"))
    within = chunks.select("_key", "_span", before("_span", "_key.chunk").alias("_chunks_before"))
    offsets = within.join(spans, "_span").select(
        "_key", (F.col("_chunks_before") + F.col("_spans_before")).alias("_offset")
    )
    local = Window.partitionBy("_key").orderBy(seq)
    numbered = rows.withColumn("_rn", F.row_number().over(local))
    return numbered.join(offsets, "_key").select(
        *df.columns, (F.col("_rn") + F.col("_offset")).cast("bigint").alias(name)
    )


def sequential_ids(
    df: DataFrame, order: Sequence[Column | str], name: str = "id", start: int = 1
) -> DataFrame:
    """Add consecutive ids from ``start`` in the given total order.

    The sort range-partitions on all order columns, so equal leading values spread when a
    tie-break follows. The sorted rows are written once to the shared checkpoint folder:
    the bounds of a range partitioning are sampled, and counting and numbering must see
    the same partitions. The offsets are one row per sort partition.
    """
    # monotonically_increasing_id holds the partition above bit 33 and the row below.
    ordered = cut_lineage(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_part", F.shiftright("_row", 33))
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")
    )
    row_id = F.col("_offset") + F.col("_row") - F.shiftleft("_part", 33) + start
    # At most one row per sort partition, so the broadcast is bounded by configuration.
    return ordered.join(F.broadcast(offsets), "_part").select(
        row_id.cast("bigint").alias(name), *df.columns
    )


def every_nth(pos: Column, n: int) -> Column:
    """True at positions n, 2n, …"""
    return F.pmod(pos, F.lit(n)) == 0


def cyclic_offsets(pos: Column, delays: Sequence[int]) -> Column:
    """Sum of the delays before position ``pos`` when ``delays`` repeat for ever.

    A message goes out before its own delay. Whole rounds and the rest of the last round
    have a closed form, so no running sum over the group is needed.
    """
    length = len(delays)
    prefix = [sum(delays[:i]) for i in range(length)]
    before = pos - 1
    rest = F.pmod(before, F.lit(length)).cast("int")
    rounds = F.floor((before - rest) / length).cast("bigint")
    return rounds * F.lit(sum(delays)) + F.element_at(
        F.array(*[F.lit(p) for p in prefix]), rest + 1
    )


def send_times(
    df: DataFrame, delays: Sequence[int], by: Sequence[str], seq: str, name: str = "send_offset"
) -> DataFrame:
    """Add the send offset of each message under a fixed (one entry) or cyclic delay list."""
    numbered = df if "pos" in df.columns else positions(df, by, seq)
    return numbered.withColumn(name, cyclic_offsets(F.col("pos"), delays))


def inject_every_nth(
    normal: DataFrame,
    abnormal: DataFrame,
    n: int,
    by: Sequence[str],
    seq: str,
    values: Sequence[str],
    on_exhausted: str = "fail",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Replace the values at positions n, 2n, … of each group by the 1st, 2nd, … abnormal ones.

    ``abnormal`` is numbered within the same groups; a frame without the group columns is
    one shared list that every group reads from its start. When abnormal values run out
    the default fails the job with a message; ``keep`` leaves the normal value.
    """
    if on_exhausted not in ("fail", "keep"):
        raise ValueError("on_exhausted must be 'fail' or 'keep'")
    if n < 1:
        raise ValueError("n must be at least 1")
    shared = not all(column in abnormal.columns for column in by)
    abnormal_by = [] if shared else list(by)
    target = positions(normal, by, seq, chunk_rows=chunk_rows)
    if shared:
        source = sequential_ids(abnormal.select(seq, *values), [seq], "_k")
    else:
        source = positions(abnormal.select(seq, *by, *values), by, seq, "_k", chunk_rows)
    source = source.select(
        *[F.col(c).alias(f"_a_{c}") for c in abnormal_by],
        F.col("_k"),
        *[F.col(v).alias(f"_a_{v}") for v in values],
    )
    hit = every_nth(F.col("pos"), n)
    # Positions that are not replaced get a key of their own that matches nothing: a shared
    # NULL key would send them all to one partition.
    target = target.withColumn(
        "_slot", F.when(hit, F.expr(f"pos div {n}")).otherwise(-F.col("pos"))
    )
    condition = F.col("_slot") == F.col("_k")
    for column in abnormal_by:
        condition = condition & (F.col(column) == F.col(f"_a_{column}"))
    joined = target.join(source, condition, "left")
    found = F.col("_k").isNotNull()
    replaced = {}
    for value in values:
        kept = F.col(value)
        if on_exhausted == "fail":
            message = F.lit(f"no abnormal value left for a position that is a multiple of {n}")
            kept = F.when(hit, F.raise_error(message).cast(normal.schema[value].dataType)).otherwise(
                F.col(value)
            )
        replaced[value] = F.when(found, F.col(f"_a_{value}")).otherwise(kept)
    return joined.withColumns({**replaced, "injected": found}).select(
        *normal.columns, "pos", "injected"
    )
