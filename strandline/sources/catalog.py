"""A catalog of Parquet tables with overwrite, append and merge by kind, and matrices as coordinate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    """Named tables under one folder. Appends are files; counters and matrices are merged when read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(name))

    def save(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self._at(name))

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self._at(name))

    def counters(self, name: str) -> DataFrame:
        """(key, v): increments summed by key."""
        return self.load(name).groupBy("key").agg(F.sum("v").alias("v"))

    def matrix(self, name: str) -> DataFrame:
        """(i, j, v): cell increments summed."""
        return merge_cells(self.load(name))


def merge_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("i", "j").agg(F.sum("v").alias("v"))


def head(rows: DataFrame, order: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n rows by position, and the rest: the two halves of a destructive read."""
    first = rows.orderBy(order).limit(n)
    return first, rows.join(first.select(order), order, "left_anti")


def packed(values: Column, *shape: int) -> Column:
    """An n-dimensional array as one value: its elements in row order and its shape, which must fit; null elements are kept."""
    size = 1
    for n in shape:
        size *= n
    fits = F.when(F.size(values) == size, values)
    return F.when(fits.isNotNull(), F.struct(fits.alias("data"), F.array(*(F.lit(n) for n in shape)).alias("shape")))


def cell(array: Column, *index: Column | int) -> Column:
    """The element of a packed array at an index, one number for each dimension; null outside."""
    place, inside = F.lit(0), F.size(array["shape"]) == len(index)
    for k, i in enumerate(index):
        i = i if isinstance(i, Column) else F.lit(i)
        n = F.get(array["shape"], k)
        place, inside = place * n + i, inside & (i >= 0) & (i < n)
    return F.when(inside, F.get(array["data"], place.cast("int")))


def by_file(sample: DataFrame, index: str, per_file: int = 100_000) -> DataFrame:
    """(file_idx, frames, n): the frames that a sample of global indexes asks of each file, sorted and once each, so that a file is opened once."""
    placed = frame_reference(sample.where(F.col(index) >= 0), index, per_file)
    return placed.groupBy("file_idx").agg(F.array_sort(F.collect_set("frame")).alias("frames"), F.count("*").alias("n"))


def without_positions(rows: DataFrame, positions: DataFrame, on: str) -> DataFrame:
    return rows.join(positions.select(on), on, "left_anti")


def delta(new: DataFrame, origin: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``new`` whose key ``origin`` lacks."""
    return new.join(origin.select(*on), on, "left_anti")


def frame_reference(rows: DataFrame, index: str, per_file: int = 100_000) -> DataFrame:
    """Adds file_idx and frame of a global index."""
    return rows.withColumns({"file_idx": F.floor(F.col(index) / per_file).cast("long"), "frame": F.pmod(F.col(index), F.lit(per_file))})


def square(triangle: DataFrame) -> DataFrame:
    """A symmetric matrix (i, j, v) from its upper triangle."""
    return triangle.select("i", "j", "v").unionByName(triangle.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def infer_value(text: Column) -> Column:
    """Kind of a text value: int (digits only), float or str."""
    return F.when(text.rlike("^[0-9]+$"), "int").when(text.try_cast("double").isNotNull(), "float").otherwise("str")
