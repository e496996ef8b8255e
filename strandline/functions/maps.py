"""Maps as column expressions: tallies that merge, lookups with a default, and the largest entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tally(keys: Column) -> Column:
    """A map from each distinct element of an array to its number."""
    return F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.size(F.filter(keys, lambda x: x == k)).cast("long").alias("value"))))


def merge(a: Column, b: Column) -> Column:
    """The sum of two maps of numbers; a key that one lacks counts 0 there, and so does a null map."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))))


def lookup(m: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), default)


def top_key(m: Column) -> Column:
    """The key of the largest value, the least key among equals; null for an empty map."""
    best = F.array_min(F.transform(F.map_entries(m), lambda e: F.named_struct(F.lit("less"), -e["value"], F.lit("key"), e["key"])))
    return best["key"]
