"""Threshold, calendar and sampling rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_range(value: Column, low: float, high: float) -> Column:
    """Validity: both ends belong to the range."""
    return value.between(low, high)


def actuator_action(value: Column, minimum: float, maximum: float) -> Column:
    """Strict thresholds; NULL when nothing is to be done."""
    return F.when(value < minimum, F.lit("power-on")).when(value > maximum, F.lit("shutdown"))


def severity(duration_ms: Column, warn: float = 15, error: float = 20) -> Column:
    return (
        F.when(duration_ms > error, F.lit("error"))
        .when(duration_ms > warn, F.lit("warning"))
        .otherwise(F.lit("info"))
    )


def colour(value: Column, red_from: float = 80) -> Column:
    return F.when(value >= red_from, F.lit("red")).otherwise(F.lit("green"))


def hex_prefix(text: Column, digits: int) -> Column:
    """First ``digits`` hex digits of the md5 of ``text`` as BIGINT (at most 15 digits)."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def in_ratio_sample(key: Column, n: int) -> Column:
    """One of ``n``, decided by the key alone, so every record of one trace agrees."""
    return F.pmod(hex_prefix(key.cast("string"), 8), F.lit(n)) == 0


def calendar_requests(ts: Column) -> Column:
    """Requests per round: office hours 80, shoulders 15, night 5, weekend none."""
    hour = F.hour(ts)
    return (
        F.when(F.weekday(ts) > 4, F.lit(0))
        .when((hour >= 9) & (hour < 18), F.lit(80))
        .when(((hour >= 6) & (hour < 9)) | ((hour >= 18) & (hour < 21)), F.lit(15))
        .otherwise(F.lit(5))
    )


def size_class(index: Column) -> Column:
    """Round robin over three file sizes."""
    turn = F.pmod(index, F.lit(3))
    return (
        F.when(turn == 0, F.lit("tiny")).when(turn == 1, F.lit("small")).otherwise(F.lit("large"))
    )


def local_iso(ts: Column, zone: str = "Europe/Stockholm") -> Column:
    """UTC timestamp as local wall-clock text."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd'T'HH:mm:ss")


def uniform(key: Column, seed: str) -> Column:
    """Uniform double in [0, 1) with 52 random bits, a pure function of seed and key.

    Unlike ``rand`` it does not depend on the partitioning, so a retried task and a
    different cluster size give the same table.
    """
    bits = hex_prefix(F.concat(F.lit(f"{seed}:"), key.cast("string")), 13)
    return bits / F.lit(float(1 << 52))


#: What an absent value counts as in a rank: less than any time, and less than any number.
ABSENT_FIRST, ABSENT_SECOND = -(2**62), -(2**63)


def rank(first: Column, second: Column | None = None) -> Column:
    """Two whole numbers, or one, as a number of fixed width that orders like the pair; nulls come first.

    Aggregations keep such a value in a hash table, while a struct makes them sort all rows. With two, ``first``
    may be 5.4e18 at most.
    """
    if second is None:
        return F.coalesce(first.cast("bigint"), F.lit(ABSENT_SECOND))
    wide = lambda c, absent: F.coalesce(c.cast("bigint"), F.lit(absent)).cast("decimal(20,0)")
    scaled = (wide(first, ABSENT_FIRST).cast("decimal(19,0)") * F.lit(2**32).cast("decimal(10,0)")) * F.lit(
        2**32
    ).cast("decimal(10,0)")
    return (scaled.cast("decimal(38,0)") + wide(second, ABSENT_SECOND)).cast("decimal(38,0)")
