"""Joins between samples, labels, workloads and matrices.

None of them asks for a broadcast: Spark broadcasts a side only when its size is under the
session threshold, otherwise it shuffles, and adaptive execution splits partitions that a hot
key makes large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POD_KEYS = ("namespace", "host", "pod_name")


def label_join(
    samples: DataFrame,
    info: DataFrame,
    keys: Sequence[str] = POD_KEYS,
    label: str = "label_workload_id",
    matcher: Column | None = None,
) -> DataFrame:
    """Attach a label of the pod info series to the samples of the same pod.

    The info series has the value 1, so multiplying by it keeps the sample value. Info rows
    are filtered and de-duplicated before the join; a pod with two label values gives one
    row for each. Samples and info belong to one evaluation step: align both first when the
    info changes over time. An absent key label equals the empty one.
    """
    wanted = info.filter(matcher) if matcher is not None else info
    wanted = wanted.select(
        *[F.coalesce(F.col(k), F.lit("")).alias(f"_i_{k}") for k in keys], label
    ).distinct()
    condition = F.lit(True)
    for key in keys:
        condition = condition & (F.coalesce(F.col(key), F.lit("")) == F.col(f"_i_{key}"))
    columns = [c for c in samples.columns if c != label]
    return samples.select(*columns).join(wanted, condition, "inner").select(*columns, label)


#: Blocks of buckets grow by this factor from level to level, up to the number of levels.
FACTOR, LEVELS = 4, 4


def _cover(low: Column, high: Column) -> Column:
    """The largest blocks (level, block) that make up the buckets ``low`` to ``high``: a logarithmic number.

    A level's blocks are those that lie inside the interval but not inside a block of the next level.
    """

    def block_of(level: int):
        return lambda x: F.struct(F.lit(level).alias("level"), x.alias("block"))

    inside = []
    for level in range(LEVELS):
        size = FACTOR**level
        inside.append((F.ceil(low / size), F.floor((high + 1) / size)))
    parts = []
    for level, (first, end) in enumerate(inside):
        runs = [(first, end)]
        if level + 1 < LEVELS:
            upper, upper_end = (x * FACTOR for x in inside[level + 1])
            some = upper < upper_end
            runs = [(first, F.when(some, upper).otherwise(end)), (F.when(some, upper_end).otherwise(end), end)]
        for start, stop in runs:
            blocks = F.when(start < stop, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<bigint>"))
            parts.append(F.transform(blocks, block_of(level)))
    return F.flatten(F.array(*parts))


def _blocks(bucket: Column) -> Column:
    """The block of each level that a bucket lies in."""
    each = [
        F.struct(F.lit(level).alias("level"), F.floor(bucket / FACTOR**level).alias("block"))
        for level in range(LEVELS)
    ]
    return F.array(*each)


def window_join(
    samples: DataFrame,
    workloads: DataFrame,
    ts: str,
    keys: Sequence[str],
    pad_s: int = 60,
    bucket_s: int = 86_400,
) -> DataFrame:
    """Samples of each workload from one minute before its start to one minute after its end.

    ``ts``, ``created_s`` and ``duration`` of the workloads are in seconds. Both ends belong to the
    window. A window is cut into blocks of 1, 4, 16 and 64 time buckets, so that it is repeated by the logarithm of
    its length; a sample is looked up in the one block that holds it of each level that any window has. The equality
    keys include the block, and the exact bounds are checked on top; blocks of a window do not overlap, so no
    pair repeats.
    """
    start = F.col("created_s") - pad_s
    end = F.col("created_s") + F.col("duration") + pad_s

    def bucket(at: Column) -> Column:
        return F.floor(at / bucket_s)

    windows = (
        workloads.withColumns({"_start": start, "_end": end})
        .withColumn("_block", F.explode(_cover(bucket(F.col("_start")), bucket(F.col("_end")))))
        .withColumnsRenamed({k: f"_w_{k}" for k in keys})
    )
    condition = F.col("_at") == F.col("_block")
    for key in keys:
        condition = condition & (F.col(key) == F.col(f"_w_{key}"))
    condition = condition & F.col(ts).between(F.col("_start"), F.col("_end"))
    carried = [c for c in workloads.columns if c not in (*keys, *samples.columns)]
    levels = windows.agg(F.collect_set("_block.level")).scalar()
    return (
        samples.withColumn("_at", F.explode(_blocks(bucket(F.col(ts)))))
        .where(F.array_contains(levels, F.col("_at.level")))
        .join(windows, condition, "inner")
        .select(*samples.columns, *carried)
    )


def label_intervals(
    snapshots: DataFrame,
    at: str,
    keys: Sequence[str] = POD_KEYS,
    label: str = "label_workload_id",
    stale: int = 300,
    slice_: int = 86_400,
) -> DataFrame:
    """From when (``since``) until before when (``until``) each pod had which ``labels``.

    ``snapshots`` have a row per pod, instant ``at`` and label value, as an exporter shows them at successive
    scrapes. What a snapshot shows of a pod holds until the pod's next snapshot, but no longer than ``stale``.
    Successive snapshots with equal labels make one interval, within a time slice: no pod's history is gathered
    in one task, and no interval is longer than a slice and ``stale``.
    """
    pods = [F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys]
    shown = (
        snapshots.groupBy(*pods, F.col(at).cast("bigint").alias("_at"))
        .agg(F.sort_array(F.collect_set(label)).alias("labels"))
        .withColumn("_slice", F.floor(F.col("_at") / slice_))
    )
    along = Window.partitionBy(*keys).orderBy("_slice")
    following = (
        shown.groupBy(*keys, "_slice")
        .agg(F.min("_at").alias("_first"))
        .select(*keys, "_slice", F.lead("_first").over(along).alias("_following"))
    )
    here = Window.partitionBy(*keys, "_slice").orderBy("_at")
    held = (
        shown.withColumn("_next", F.lead("_at").over(here))
        .join(following, [*keys, "_slice"])
        .withColumn("_until", F.least(F.coalesce("_next", "_following"), F.col("_at") + stale))
        .withColumn(
            "_new",
            ~(
                F.col("labels").eqNullSafe(F.lag("labels").over(here))
                & F.col("_at").eqNullSafe(F.lag("_until").over(here))
            ),
        )
        .withColumn("_run", F.count(F.when(F.col("_new"), 1)).over(here))
    )
    return held.groupBy(*keys, "_slice", "_run", "labels").agg(
        F.min("_at").alias("since"), F.max("_until").alias("until")
    ).select(*keys, "labels", "since", "until")


def label_join_over_time(
    samples: DataFrame,
    snapshots: DataFrame,
    ts: str,
    at: str,
    keys: Sequence[str] = POD_KEYS,
    label: str = "label_workload_id",
    stale: int = 300,
    slice_: int = 86_400,
) -> DataFrame:
    """``label_join`` with the labels that a pod had at the time of the sample.

    ``ts`` and ``at`` are in the same unit, as are ``stale`` and ``slice_``. Samples of pods whose latest snapshot is
    ``stale`` old, or that have none, are left out; a pod with two label values gives one row for each.
    """
    wanted = label_intervals(snapshots, at, keys, label, stale, slice_).withColumn(
        "_slice", F.explode(F.sequence(F.floor(F.col("since") / slice_), F.floor((F.col("until") - 1) / slice_)))
    )
    wanted = wanted.select(*[F.col(k).alias(f"_i_{k}") for k in keys], "labels", "since", "until", "_slice")
    condition = (F.floor(F.col(ts) / slice_) == F.col("_slice")) & (F.col(ts) >= F.col("since"))
    condition = condition & (F.col(ts) < F.col("until"))
    for key in keys:
        condition = condition & (F.coalesce(F.col(key), F.lit("")) == F.col(f"_i_{key}"))
    columns = [c for c in samples.columns if c != label]
    joined = samples.select(*columns).join(wanted, condition, "inner")
    return joined.select(*columns, F.explode("labels").alias(label))


def matrix_product(a: DataFrame, b: DataFrame, heavy: int = 1 << 16) -> DataFrame:
    """Product of two matrices in coordinate form ``(i, j, v)``.

    Work is the number of products a sparse multiplication needs; they are summed on the
    map side before they are shuffled by output cell. An inner index with more than ``heavy`` entries on a side is
    a grid of blocks: each side's entries are dealt out along one edge of the grid and repeated along the
    other, so a block has about ``heavy`` entries a side and every pair meets in one block.
    """
    left = a.select("i", F.col("j").alias("_k"), F.col("v").alias("_va"))
    right = b.select(F.col("i").alias("_k"), "j", F.col("v").alias("_vb"))
    sides = left.select("_k", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        right.select("_k", F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    # A row per heavy index: at most one for every `heavy` entries.
    grid = (
        sides.groupBy(F.col("_k").alias("_heavy"))
        .agg(F.sum("_a").alias("_n_a"), F.sum("_b").alias("_n_b"))
        .filter((F.greatest("_n_a", "_n_b") > heavy) & (F.least("_n_a", "_n_b") > 0))
        .select("_heavy", *[F.ceil(F.col(f"_n_{x}") / heavy).cast("int").alias(f"_{x}s") for x in "ab"])
    )

    def dealt(side: DataFrame, by: str, along: str, across: str) -> DataFrame:
        """Entries with their blocks: one along an edge of the grid, all across."""
        known = side.join(grid, F.col("_k") == F.col("_heavy"), "left")
        wide = F.coalesce(F.col(f"_{along}s"), F.lit(1))
        others = F.sequence(F.lit(0), F.coalesce(F.col(f"_{across}s"), F.lit(1)) - 1)
        return known.select(
            *side.columns, F.pmod(F.xxhash64(by), wide).cast("int").alias(f"_at_{along}"), F.explode(others).alias(f"_at_{across}")
        )

    met = dealt(left, "i", "a", "b").join(dealt(right, "j", "b", "a"), ["_k", "_at_a", "_at_b"])
    return met.groupBy("i", "j").agg(F.sum(F.col("_va") * F.col("_vb")).alias("v"))
