"""All distances between rows that are too many to be multiplied as rows: blocks of bounded size meet, one pair of blocks a task's group.

Spark deals the rows to blocks and the blocks to pairs; a group's distances are one matrix product, of which only sums,
extremes or the nearest rows leave the task. Where the product cancels (rows close together) and where two distances
decide by a hair, the distance is added up element by element, as ``vec.distance`` does.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Rows of a block, and elements of the part of a distance matrix that is held at once.
BLOCK, TILE = 8_192, 1 << 21
#: Products whose share of the squared norms is less are added up anew; beyond, their error is under SLACK of the norms.
CLOSE, SLACK = 1e-4, 1e-12


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors as the rows of a matrix."""
    column = column.combine_chunks()
    flat = column.flatten()
    sizes = np.unique(pc.list_value_length(column).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(1, int)
    if sizes.size > 1 or flat.null_count:
        raise ValueError("vectors of different lengths or with null elements")
    return flat.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), int(sizes[0]))


def codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Values as numbers in their order, equal ones for equal values; null is a value."""
    whole = pa.chunked_array([c for column in columns for c in column.chunks], type=columns[0].type).combine_chunks()
    keyed = whole.dictionary_encode(null_encoding="encode")
    rank = np.empty(len(keyed.dictionary), dtype=np.int64)
    rank[pc.sort_indices(keyed.dictionary).to_numpy()] = np.arange(rank.size)
    found = rank[keyed.indices.to_numpy(zero_copy_only=False)]
    return np.split(found, np.cumsum([len(c) for c in columns])[:-1])


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of corresponding rows, element after element."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        step = a[:, k] - b[:, k]
        out += step * step
    return out


def _anew(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    step = 1 << 16
    return np.concatenate([added(a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, i.size, step)] or [np.zeros(0)])


def squared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of all rows of ``a`` and ``b``, and a bound of their error."""
    middle = b.mean(axis=0) if len(b) else 0.0
    x, y = a - middle, b - middle
    p, q = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    d = x @ y.T
    d *= -2
    d += p[:, None]
    d += q
    scale = float(p.max(initial=0) + q.max(initial=0))
    i, j = np.nonzero(~(d > CLOSE * scale))
    d[i, j] = _anew(a, b, i, j)
    return d, SLACK * scale


def _dealt(name: str, blocks: Column | int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(blocks) if isinstance(blocks, int) else blocks).cast("int")


def _numbers(n: Column | int) -> Column:
    return F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1).cast("array<int>")


def pair_statistics(rows: DataFrame, name: str, vector: str, within: str) -> DataFrame:
    """Number, mean and extremes of the distances of all pairs a < b of rows of one group: (within, n, mean, least, most).

    Every pair is measured, so the work grows with the square of a group; what is held and shuffled does not: a row goes to
    each pair of blocks of its group that has its block.
    """
    held = rows.where(F.col(within).isNotNull() & (F.size(vector) > 0)).select(F.col(within).alias("g"), F.col(name).alias("name"), F.col(vector).alias("v"))
    sizes = held.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = held.join(sizes, "g").withColumn("own", _dealt("name", F.col("blocks"))).withColumn("other", F.explode(_numbers(F.col("blocks"))))
    met = own.select("g", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "name", "v")

    def measured(key: tuple, group: pa.Table) -> pa.Table:
        _, lo, hi = (k.as_py() for k in key)
        v, own, (place,) = matrix(group["v"]), group["own"].to_numpy(), codes(group["name"])
        first, second = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        n, total, least, most = 0, 0.0, np.inf, -np.inf
        step = max(1, TILE // max(1, second.size))
        for k in range(0, first.size, step):
            some = first[k : k + step]
            d = squared(v[some], v[second])[0]
            if lo == hi:
                d = d[place[some][:, None] < place[second]]
            if d.size:
                d = np.sqrt(d)
                n, total, least, most = n + d.size, total + float(d.sum()), min(least, float(d.min())), max(most, float(d.max()))
        return pa.table({"g": pa.array([key[0].as_py()], key[0].type), "n": [n], "total": [total], "least": [least], "most": [most]})

    kind = rows.schema[within].dataType.simpleString()
    ship(rows.sparkSession)
    parts = met.groupBy("g", "lo", "hi").applyInArrow(measured, f"g {kind}, n long, total double, least double, most double").where("n > 0")
    return parts.groupBy(F.col("g").alias(within)).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.min("least").alias("least"), F.max("most").alias("most"))


def met(rows: DataFrame, queries: DataFrame, name: str, parts: int, found: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``found`` of each block of queries, of ``parts``, and each block of rows; both have the columns name, v and the same others."""
    blocks = max(1, -(-rows.count() // BLOCK))
    a = queries.select(F.lit(True).alias("asks"), _dealt(name, parts).alias("part"), F.explode(_numbers(blocks)).alias("block"), *queries.columns)
    b = rows.select(F.lit(False).alias("asks"), F.explode(_numbers(parts)).alias("part"), _dealt(name, blocks).alias("block"), *rows.columns)

    def judged(group: pa.Table) -> pa.Table:
        return found(group.filter(group["asks"]), group.filter(pc.invert(group["asks"])))

    ship(rows.sparkSession)
    return a.unionByName(b).groupBy("part", "block").applyInArrow(judged, schema)


def nearest(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest rows of each query but itself, lower names first among equals: (query, name, d)."""

    def found(asked: pa.Table, rows: pa.Table) -> pa.Table:
        q, v, (own, place) = matrix(asked["v"]), matrix(rows["v"]), codes(asked["name"], rows["name"])
        kept_i, kept_j, kept_d = [], [], []
        both = np.flatnonzero(np.isin(place, own))
        step = max(1, TILE // max(1, len(v)))
        for at in range(0, len(q) if len(v) else 0, step):
            d, slack = squared(q[at : at + step], v)
            i, j = np.nonzero(own[at : at + step, None] == place[both])
            d[i, both[j]] = np.inf
            last = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k < len(v) else np.inf
            i, j = np.nonzero(~(d > last + 2 * slack))
            i += at
            i, j = (x[own[i] != place[j]] for x in (i, j))
            exact = np.sqrt(_anew(q, v, i, j))
            order = np.lexsort((place[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.arange(i.size) - np.searchsorted(i, i) < k
            kept_i.append(i[first]), kept_j.append(j[first]), kept_d.append(exact[first])
        i, j, d = (np.concatenate(x) if x else np.zeros(0, int) for x in (kept_i, kept_j, kept_d))
        return pa.table({"query": asked["name"].take(pa.array(i)), "name": rows["name"].take(pa.array(j)), "d": pa.array(d, pa.float64())})

    return found


def weights(radius: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Per query and label: summed 1 / d of the other rows under ``radius`` that share a bucket with it (column h, one bucket a table): (query, label, w)."""

    def found(asked: pa.Table, rows: pa.Table) -> pa.Table:
        (label,) = codes(rows["label"])
        order = np.argsort(label, kind="stable")
        rows, label = rows.take(pa.array(order)), label[order]
        q, v, (own, place) = matrix(asked["v"]), matrix(rows["v"]), codes(asked["name"], rows["name"])
        h, g = matrix(asked["h"]), matrix(rows["h"])
        start = np.flatnonzero(np.diff(label, prepend=-1))
        kept_i, kept_k, kept_w = [], [], []
        both = np.flatnonzero(np.isin(place, own))
        step = max(1, TILE // max(1, len(v)))
        for at in range(0, len(q) if len(v) else 0, step):
            d, slack = squared(q[at : at + step], v)
            i, j = np.nonzero(np.abs(d - radius * radius) <= slack)
            d[i, j] = _anew(q[at : at + step], v, i, j)
            d = np.sqrt(d)
            near = np.zeros(d.shape, dtype=bool)
            for t in range(h.shape[1]):
                near |= h[at : at + step, t, None] == g[:, t]
            near &= d < radius
            i, j = np.nonzero(own[at : at + step, None] == place[both])
            near[i, both[j]] = False
            w = np.add.reduceat(np.where(near, 1 / np.maximum(d, 1e-9), 0.0), start, axis=1)
            i, k = np.nonzero(w > 0)
            kept_i.append(i + at), kept_k.append(start[k]), kept_w.append(w[i, k])
        i, k, w = (np.concatenate(x) if x else np.zeros(0, int) for x in (kept_i, kept_k, kept_w))
        return pa.table({"query": asked["name"].take(pa.array(i)), "label": rows["label"].take(pa.array(k)), "w": pa.array(w, pa.float64())})

    return found
