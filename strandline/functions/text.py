"""Strings, keys and times of job logs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_braces(s: Column) -> Column:
    """Without brackets, braces, parentheses and commas."""
    return F.translate(s, "()[]{},", "")


def wrap_key(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), key)


def unwrap_key(key: Column) -> Column:
    """What follows the first underscore; the key itself if there is none."""
    return F.when(F.locate("_", key) > 0, F.substring(key, F.locate("_", key) + 1, F.length(key))).otherwise(key)


def duration_seconds(s: Column) -> Column:
    """Seconds of ``D-HH:MM:SS``, ``HH:MM:SS`` or ``MM:SS``; null for anything else."""
    pattern = r"^(?:(?:(\d+)-)?(\d+):)?(\d+):(\d+)$"

    def part(k: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(s, pattern, k), F.lit("")).cast("long"), F.lit(0).cast("long"))

    return F.when(s.rlike(pattern), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def seconds_between(a: Column, b: Column) -> Column:
    """Absolute difference of two timestamps in seconds."""
    return F.abs(F.unix_timestamp(a.cast("timestamp")) - F.unix_timestamp(b.cast("timestamp")))


def job_number(name: Column) -> Column:
    """100 * m + w of names like ``prefix-m.w``; null for others."""
    pattern = r"(\d+)\.(\d+)$"
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1).cast("long") * 100 + F.regexp_extract(name, pattern, 2).cast("long"))


def natural_key(s: Column) -> Column:
    """Sort key of names like ``prefix_12``: the prefix, then the number."""
    return F.struct(F.regexp_extract(s, r"^(.*?)(\d*)$", 1).alias("prefix"), F.regexp_extract(s, r"(\d*)$", 1).try_cast("long").alias("number"))
