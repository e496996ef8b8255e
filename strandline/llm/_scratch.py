"""Cutting lineage with tables in the folder that driver and executors share.

Every long-lived intermediate is written as Parquet under ``spark.checkpoint.dir`` and read
again, so a lost executor costs the tasks it was running and nothing before them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import shared_root
from ..session import ship

#: A side of a join is broadcast only when its counted rows, at their estimated width, stay below this.
BROADCAST_BYTES = 32 << 20


#: The setting by which Spark deletes the shuffle files of a query when it has ended, and not when the driver happens to collect its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of a filter at most. A fuller one lets more rows through, and loses none.
FILTER_BITS = 1 << 26


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files behind; their results must have been written."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)


class Scratch:
    """Tables of one operator run. ``keep`` writes and rereads one; ``drop`` frees one that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = ship(spark)
        self.base = f"{shared_root(spark)}/strandline/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: list[str] = []

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{label}"

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        at = self.path(label)
        with shuffles_freed(self.spark):
            df.write.parquet(at)
        self.tables.append(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._strandline_path = at
        return out

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """Kept tables of one schema as one, whose files are dealt to tasks by size and not table by table."""
        return self.spark.read.schema(tables[0].schema).parquet(*(t._strandline_path for t in tables))

    def drop(self, df: DataFrame) -> None:
        at = getattr(df, "_strandline_path", None)
        if at:
            self._delete(at)

    def clear(self, *still_read: DataFrame) -> None:
        """Free all tables but those that ``still_read`` names; what was derived from the others must have been kept before."""
        stay = {getattr(df, "_strandline_path", None) for df in still_read}
        for at in self.tables:
            if at not in stay:
                self._delete(at)
        self.tables = [at for at in self.tables if at in stay]

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fits(row_bytes: int, rows: int) -> bool:
    """Whether a side of so many rows is broadcast."""
    return rows * row_bytes <= BROADCAST_BYTES


def sized_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str, row_bytes: int, rows: int) -> DataFrame:
    """Join ``big`` with ``small``, whose ``rows`` were counted: broadcast under the bound, else a shuffled hash join."""
    if fits(row_bytes, rows):
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("shuffle_hash"), on, how)


def may_hold(big: DataFrame, small: DataFrame, on: str, rows: int) -> DataFrame:
    """``big`` without most of the rows whose long column ``on`` is not among the at most ``rows`` values of ``small``; no other row is lost.

    It goes before a shuffled join, where ``big`` is wide. The values of ``small`` set bits of a filter of bounded size, which is broadcast.
    """
    bits = min(FILTER_BITS, 1 << max(15, (8 * rows).bit_length()))
    at = F.pmod(F.xxhash64(on), F.lit(bits))
    slot, place, words = fresh(big.columns, "slot", "place", "words")
    set_ = small.select(F.floor(at / 4096).alias(slot), F.floor(F.pmod(at, F.lit(4096)) / 64).cast("int").alias("word"), F.pmod(at, F.lit(64)).cast("int").alias(place))
    set_ = set_.groupBy(slot, "word").agg(F.bit_or(F.expr(f"shiftleft(1L, `{place}`)")).alias("bits"))
    held = set_.groupBy(slot).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    held = held.select(slot, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.coalesce(F.try_element_at("held", k), F.lit(0).cast("long"))).alias(words))
    asked = big.withColumns({slot: F.floor(at / 4096), place: F.pmod(at, F.lit(4096)).cast("int")}).join(F.broadcast(held), slot)
    return asked.where(f"shiftright(get(`{words}`, `{place}` div 64), `{place}` % 64) & 1 = 1").select(*big.columns)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names like ``names`` that differ from the columns ``taken``, whatever their case."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out
