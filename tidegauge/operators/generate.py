"""Synthetic telemetry tables.

Values are a pure function of (seed, row id): no random state, so a table is the same for
every partitioning and after every retry. Row ids come from any table or ``spark.range``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from . import numbering, readings

RANDOM_DELAYS = 10  # entries of a random delay list


def uniform_int(key: Column, low: float, high: float, seed: str) -> Column:
    """Integer in ``[floor(low), ceil(high))``."""
    first, last = math.floor(low), math.ceil(high)
    if last <= first:
        raise ValueError("the range holds no integer")
    return (F.floor(rules.uniform(key, seed) * (last - first)) + first).cast("int")


def uniform_float(key: Column, low: float, high: float, seed: str) -> Column:
    """Double in ``[low, high)``."""
    return rules.uniform(key, seed) * (float(high) - float(low)) + float(low)


@dataclass(frozen=True)
class ValueRange:
    low: float
    high: float


def value_rows(ids: DataFrame, id_col: str, values: ValueRange, seed: str, name: str) -> DataFrame:
    """Rows of one value file: temperature and humidity drawn independently of each other."""
    key = F.col(id_col)
    return ids.select(
        key.alias("row_id"),
        F.lit(name).alias("class"),
        uniform_int(key, values.low, values.high, f"{seed}:{name}:t").alias("temperature"),
        uniform_float(key, values.low, values.high, f"{seed}:{name}:h").alias("humidity"),
    )


def value_table(
    normal_ids: DataFrame | None,
    abnormal_ids: DataFrame | None,
    id_col: str,
    normal: ValueRange,
    abnormal: ValueRange,
    seed: str,
    kind: str = "both",
) -> DataFrame:
    """Value rows of kind ``normal``, ``abnormal`` or ``both`` with a ``class`` column."""
    parts = []
    if kind in ("normal", "both"):
        parts.append(value_rows(normal_ids, id_col, normal, seed, "normal"))
    if kind in ("abnormal", "both"):
        parts.append(value_rows(abnormal_ids, id_col, abnormal, seed, "abnormal"))
    if not parts:
        raise ValueError("kind must be 'normal', 'abnormal' or 'both'")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def fan_out(df: DataFrame, sensors: int, pod: str) -> DataFrame:
    """Repeat every row for each sensor ``{pod}-{n}``; a generator, so there is no join."""
    if sensors < 1:
        raise ValueError("at least one sensor is needed")
    number = F.explode(F.sequence(F.lit(0), F.lit(sensors - 1)))
    return df.withColumn("_n", number).withColumn(
        "sensor", F.concat(F.lit(f"{pod}-"), F.col("_n").cast("string"))
    ).drop("_n")


def with_random_offset(
    df: DataFrame, low_s: float, high_s: float, seed: str, name: str = "send_offset"
) -> DataFrame:
    """Add the send offset in ms under a sensor's own cyclic list of ten random delays.

    Columns: sensor, pos. The ten delays of a row's sensor are drawn once per row; their
    sums give every offset, so there is neither a join nor a running sum.
    """
    names = [f"_delay{i}" for i in range(RANDOM_DELAYS)]
    draws = {
        name: F.round(
            uniform_float(
                F.concat(F.col("sensor"), F.lit(f"#{i}")), low_s * 1000, high_s * 1000, f"{seed}:delay"
            )
        ).cast("bigint")
        for i, name in enumerate(names)
    }
    # sums[i] is the time before the i-th message of a round, the last one the whole round.
    sums = [F.lit(0).cast("bigint")]
    for column in names:
        sums.append(sums[-1] + F.col(column))
    before = F.col("pos") - 1
    rest = F.pmod(before, F.lit(RANDOM_DELAYS)).cast("int")
    rounds = F.floor((before - rest) / RANDOM_DELAYS).cast("bigint")
    offset = rounds * sums[-1] + F.element_at(F.array(*sums[:-1]), rest + 1)
    return df.withColumns(draws).withColumn(name, offset).drop(*names)


def telemetry(
    normal: DataFrame,
    abnormal: DataFrame,
    sensors: int,
    pod: str,
    mode: str = "normal",
    every: int = 10,
    delay: Sequence[int] | tuple[float, float] = (1000,),
    delay_type: str = "fixed",
    start_ms: int = 0,
    seed: str = "0",
    on_exhausted: str = "fail",
) -> DataFrame:
    """Telemetry text of ``sensors`` devices that each send one pass over the value rows.

    ``mode`` is normal, abnormal or mixed (every ``every``-th value abnormal). ``delay`` is
    a list of ms (fixed) or a range in seconds (random). The value rows are numbered once,
    before they are repeated per sensor: all sensors share the positions.
    """
    columns = ["row_id", "temperature", "humidity"]
    source = {"normal": normal, "mixed": normal, "abnormal": abnormal}[mode].select(*columns)
    if mode == "mixed":
        # Both files as one group each: the constant marks the single shared list.
        rows = numbering.inject_every_nth(
            source.withColumn("_file", F.lit(0)),
            abnormal.select(*columns).withColumn("_file", F.lit(0)),
            every,
            ["_file"],
            "row_id",
            ["temperature", "humidity"],
            on_exhausted,
        ).drop("_file")
    else:
        rows = numbering.positions(source.withColumn("_file", F.lit(0)), ["_file"], "row_id").drop("_file")
    rows = fan_out(rows, sensors, pod)
    if delay_type == "fixed":
        rows = rows.withColumn("send_offset", numbering.cyclic_offsets(F.col("pos"), list(delay)))
    elif delay_type == "random":
        rows = with_random_offset(rows, delay[0], delay[1], seed)
    else:
        raise ValueError("delay_type must be 'fixed' or 'random'")
    timed = rows.withColumn("measurement_ts", F.lit(start_ms).cast("bigint") + F.col("send_offset"))
    return readings.compose_telemetry(timed).select(
        "sensor", "pos", "measurement_ts", "temperature", "humidity", "value"
    )
