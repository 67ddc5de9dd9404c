"""What several operators of this subpackage need: shared tables, prefix sums, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.session import cut_lineage, ensure_checkpoint_dir


def tidy() -> None:
    """Give memory that a Python worker no longer uses back to the machine.

    Workers are used again by later stages, and what allocators keep adds up over them.
    """
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@contextmanager
def remembering() -> Iterator[None]:
    """For code that keeps very many small values without cycles: rarely look for cycles meanwhile."""
    before = gc.get_threshold()
    gc.set_threshold(200_000, 50, 100)
    try:
        yield
    finally:
        gc.set_threshold(*before)
        gc.collect()
        tidy()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from it.

    Smaller on disk than a checkpoint, which keeps rows uncompressed. The files outlive lost
    executors; they go with the checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(a: DataFrame, b: DataFrame, names: Iterable[str]) -> Column:
    """Equality of the named columns in which two nulls are equal."""
    condition = F.lit(True)
    for name in names:
        condition = condition & a[name].eqNullSafe(b[name])
    return condition


def carried(
    df: DataFrame, used: Iterable[str], added: Iterable[str], run: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``run(df)``, for which all columns but those ``used`` have names that clash with nothing.

    They get their own names back. Columns of ``df`` named as one of the ``added`` are replaced by it.
    """
    used, added = set(used), set(added)
    more = [c for c in df.columns if c not in used]
    names = {c: f"_further{i}" for i, c in enumerate(more)}
    own = {f"_further{i}": c for i, c in enumerate(more)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    out = run(df.select(*[quoted(c).alias(names.get(c, c)) for c in df.columns]))
    return out.select(*[quoted(c).alias(own.get(c, c)) for c in out.columns if own.get(c) not in added])


def running(
    df: DataFrame, order: list[str], sums: dict[str, str], group: list[str] | None = None
) -> DataFrame:
    """Add ``position`` (from 0) and, per item of ``sums``, the sum of a column over earlier rows.

    Rows are ordered by ``order`` within ``group``. No group and no order value has to fit into
    one task: rows are dealt out by ranges of (group, order, row number), each partition is summed
    by itself, and the totals of earlier partitions are added. Rows that agree in ``order`` get
    successive positions. ``sums`` names the new column and the column that is summed. Columns with the names
    added are replaced.
    """
    used = [*order, *sums.values(), *(group or [])]
    return carried(df, used, ["position", *sums], lambda rows: _running(rows, order, sums, group or []))


def _running(df: DataFrame, order: list[str], sums: dict[str, str], group: list[str]) -> DataFrame:
    spread = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(partitions(df.sparkSession), *group, *order, "_tie")
        .withColumn("_part", F.spark_partition_id())
    )
    # The bounds of the ranges are sampled: both uses below must see the same partitions.
    spread = cut_lineage(spread)
    totals = spread.groupBy("_part", *group).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(v).alias(f"_sum_{k}") for k, v in sums.items()]
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        *group,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        *[F.coalesce(F.sum(f"_sum_{k}").over(earlier), F.lit(0)).alias(f"_{k}_before") for k in sums],
    )
    own = Window.partitionBy("_part", *group).orderBy(*order, "_tie")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    local = spread.withColumns(
        {"_row": F.row_number().over(own) - 1}
        | {f"_{k}_here": F.coalesce(F.sum(v).over(before), F.lit(0)) for k, v in sums.items()}
    )
    joined = local.join(offsets, same(local, offsets, ["_part", *group]))
    return joined.select(
        *[local[c] for c in df.columns],
        (F.col("_row") + F.col("_rows_before")).alias("position"),
        *[(F.col(f"_{k}_here") + F.col(f"_{k}_before")).alias(k) for k in sums],
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the ``edges`` (a, b): rows (node, root), root the smallest node.

    Large-star and small-star steps in turn. A star step is a minimum per node, which is combined
    before the shuffle, and a join back that adaptive execution can split, so a node with very
    many neighbours does not land in one task. Every step works on a written table.
    """
    edges = cut_lineage(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = (
            both.where("b > a")
            .join(least, "a")
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .where("a <> b")
            .distinct()
        )
        large = cut_lineage(large)
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
            .where("a <> b")
            .distinct()
        )
        edges = cut_lineage(small)
        row = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
