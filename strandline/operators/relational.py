"""The experiment database: facts joined to dimensions, roll-ups, nested aggregates and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_rollup(facts: DataFrame, dims: list[tuple[DataFrame, str, str]], by: list[str], value: str) -> DataFrame:
    """Facts joined to dimensions (table, fact column, dimension column), then n, mean, max and total of a value by keys.

    Small dimensions are broadcast by the optimiser, by their size on disk; large ones are merged.
    """
    out = facts
    for dim, left, right in dims:
        out = out.join(dim, out[left] == dim[right])
    return out.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"), F.sum(value).alias("total"))


def nested_stdev(rows: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """Sample deviation within inner groups (null for one row), then its mean and that of the means over outer groups."""
    groups = rows.groupBy(*outer, *inner).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    return groups.groupBy(*outer).agg(F.avg("m").alias("mean"), F.avg("s").alias("deviation"), F.count("*").alias("groups"), F.count("s").alias("with_deviation"))


def ranks(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """rank, dense rank, quartile and share of each row in its group, in the order of ``order`` descending."""
    w = Window.partitionBy(by).orderBy(*(F.desc(c) for c in order), name)
    return rows.select(by, name, F.rank().over(Window.partitionBy(by).orderBy(F.desc(order[0]))).alias("rank"), F.dense_rank().over(Window.partitionBy(by).orderBy(F.desc(order[0]))).alias("dense"), F.ntile(4).over(w).alias("quartile"))


def upsert(target: DataFrame, changes: DataFrame, on: list[str]) -> DataFrame:
    """``target`` with the rows of ``changes`` in place of those with the same key."""
    return target.join(changes.select(*on), on, "left_anti").unionByName(changes.select(*target.columns))
