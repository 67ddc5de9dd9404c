"""Expressions over message text, labels and names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
# Spark's text-to-double cast also takes Java suffixes such as '1.5d'; the device format does not.
FLOAT_TEXT = (
    r"(?i)^\s*[+-]?(?:nan|inf|infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)\s*$"
)


def second_part(text: Column, separator: str = ":") -> Column:
    """Text between the first two separators; NULL when there is none."""
    return F.try_element_at(F.split(text, separator), F.lit(2))


def field_after_colon(text: Column, separator: str, position: int) -> Column:
    """Second ``:``-part of the ``position``-th (1-based) part of ``text``; NULL when absent."""
    return second_part(F.try_element_at(F.split(text, separator), F.lit(position)))


def drop_last(text: Column, n: int) -> Column:
    """Text without its last ``n`` characters; empty when it is shorter."""
    return F.substring(text, F.lit(1), F.greatest(F.length(text) - n, F.lit(0)))


def to_int(text: Column) -> Column:
    return text.try_cast("int")


def to_bigint(text: Column) -> Column:
    return text.try_cast("bigint")


def to_double(text: Column) -> Column:
    # Plain decimals need no pattern; the cast alone decides them.
    plain = F.translate(text, "0123456789.+-", "") == ""
    return F.when(plain | text.rlike(FLOAT_TEXT), text.try_cast("double"))


def millis_text_to_seconds(text: Column) -> Column:
    """Epoch ms text to epoch s by cutting the last three characters; NULL when nothing is left."""
    return to_bigint(drop_last(text, 3))


def full_match(value: Column, pattern: str) -> Column:
    """Label matcher ``=~``: the pattern must match the whole value; an absent label is empty."""
    return F.coalesce(value, F.lit("")).rlike(rf"\A(?:{pattern})\z")


def glob_any(value: Column, globs: Iterable[str]) -> Column:
    """True when ``value`` equals one of the names or matches one with ``*``."""
    names = list(globs)
    plain = [g for g in names if "*" not in g]
    matched = value.isin(plain) if plain else F.lit(False)
    for pattern in (g for g in names if "*" in g):
        escaped = pattern.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
        matched = matched | value.like(escaped.replace("*", "%"))
    return matched


def short_pod_name(pod: Column, suffix: int = 14) -> Column:
    """Pod name without its generated suffix."""
    return drop_last(pod, suffix)


def namespace_of(username: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(username), "[^a-z0-9-]", ""), 1, 45)


def role_of(username: Column) -> Column:
    return F.regexp_replace(username, "[0-9]$", "")


def workload_name_of(display_name: Column) -> Column:
    return F.replace(F.lower(display_name), F.lit(" "), F.lit("-"))


def set_values(text: Column) -> Column:
    """``a=b; c=d`` to an array of trimmed pairs; NULL, empty and the text ``null`` give none."""
    present = text.isNotNull() & ~text.isin("", "null")
    pairs = F.transform(F.split(text, ";"), lambda pair: F.trim(pair))
    return F.when(present, pairs).otherwise(F.array().cast("array<string>"))


def contains_word(text: Column, word: str) -> Column:
    """``word`` occurs as a token of lower-cased ``text``; scans the whole text, builds no array."""
    return F.lower(text).rlike(rf"(\A|[^a-z0-9]){re.escape(word.lower())}([^a-z0-9]|\z)")


def cut_fraction(iso_text: Column) -> Column:
    """Text before the last ``.``; text without one becomes empty."""
    return F.when(
        F.contains(iso_text, F.lit(".")), F.regexp_replace(iso_text, r"\.[^.]*$", "")
    ).otherwise(F.lit(""))


def blank_if_null(text: Column) -> Column:
    """NULL and the text ``null`` shown as empty."""
    return F.coalesce(F.nullif(text, F.lit("null")), F.lit(""))


def valid_cpu(text: Column) -> Column:
    value = F.trim(text)
    return value.rlike(r"\A(?:[0-9]+m)?\z")


def valid_memory(text: Column) -> Column:
    value = F.trim(text)
    return value.rlike(r"\A(?:[0-9]+[MG]i)?\z")


def valid_workload_name(text: Column) -> Column:
    return text.rlike(r"\A[A-Za-z0-9][A-Za-z0-9_-]*\z")
