"""All queries of the library by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import labelling, lattices, relational, sequences, space, statistics, streams

_PARTS = (labelling, sequences, statistics, space, lattices, relational, streams)


def _long_integers(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Results with int columns as long, as other engines count."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = query(spark, sf_dir)
        return out.select(*(F.col(f"`{c}`").cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, kind in out.dtypes))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _long_integers(query) for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
