"""Arithmetic on array<double> columns; all stays in Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), for an f that names its value many times: it is evaluated once a row, not at each mention."""
    return F.get(F.transform(F.array(value), f), 0)


def doubles(v: Column | str) -> Column:
    """An array with its elements cast to double."""
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(squared_distance(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def rmsd(a: Column, b: Column) -> Column:
    """Root of the mean squared difference of the elements."""
    return F.sqrt(squared_distance(a, b) / F.size(a))


def mean_root_distance(a: Column, b: Column, width: int) -> Column:
    """Root of the mean of point distances, for points of ``width`` successive elements."""
    return F.sqrt(total(point_distances(a, b, width)) / (F.size(a) / width))


def scaled_distance_sum(a: Column, b: Column, width: int) -> Column:
    """Sum of point distances over the root of the number of points."""
    return total(point_distances(a, b, width)) / F.sqrt(F.size(a) / width)


def point_distances(a: Column, b: Column, width: int) -> Column:
    """Distances of corresponding points of ``width`` successive elements."""
    steps = F.sequence(F.lit(0), (F.size(a) / width).cast("int") - 1)
    return F.transform(steps, lambda k: distance(F.slice(a, k * width + 1, width), F.slice(b, k * width + 1, width)))


def gather(v: Column, places: Column) -> Column:
    """The elements at zero-based places, in the order of places."""
    return F.transform(places, lambda k: F.get(v, k))


def at(v: Column | str, k: int) -> Column:
    return F.get(v, k).cast("double")


def pair_distances(points: Column, width: int = 3) -> Column:
    """Upper triangle of the distances between points of ``width`` successive elements, in combination order."""
    n = (F.size(points) / width).cast("int")

    def row(i: Column) -> Column:
        others = F.when(i + 1 < n, F.sequence(i + 1, n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(others, lambda j: distance(F.slice(points, i * width + 1, width), F.slice(points, j * width + 1, width)))

    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), row))


def contact(a: Column, r0: float = 7.5) -> Column:
    """Smooth contact value (1 - r^2) / (1 - r^3) of a distance, r = distance / r0; 2/3 at r0 itself."""
    r = a / F.lit(r0)
    return F.when(r == 1.0, F.lit(2.0 / 3.0)).otherwise((1 - r * r) / (1 - r * r * r))


def logistic(x: Column, top: float = 1.0, steep: float = 1.0, middle: float = 0.0) -> Column:
    """top / (1 + exp(-steep * (x - middle)))."""
    return F.lit(top) / (1 + F.exp(F.lit(-steep) * (x - middle)))
