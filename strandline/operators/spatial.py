"""Space partitions: k-d trees built level by level, grids of half spaces, cells and their overlaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..lineage import cut
from . import blocks

#: Size of a block of queries.
QUERY_BYTES = 64 << 20

METHODS = ("median", "mean", "middle", "max_gap")


def _splits(points: DataFrame, axis: str, method: str) -> DataFrame:
    """Per path: mid (the split value), lo, hi and n."""
    base = [F.count("*").alias("n"), F.min(axis).alias("lo"), F.max(axis).alias("hi")]
    if method == "max_gap":
        w = Window.partitionBy("path").orderBy(axis)
        gaps = points.select("path", axis, (F.lead(axis).over(w) - F.col(axis)).alias("gap"))
        widest = F.max_by(F.col(axis) + F.col("gap") / 2, F.struct(F.coalesce("gap", F.lit(-1.0)), -F.col(axis)))
        return gaps.groupBy("path").agg(widest.alias("mid"), *base)
    mids = {"median": F.percentile(axis, F.lit(0.5)), "mean": F.avg(axis), "middle": (F.max(axis) + F.min(axis)) / 2}
    return points.groupBy("path").agg(mids[method].alias("mid"), *base)


def kd_tree(points: DataFrame, axes: list[str], method: str = "median", max_depth: int = 3, leaf_size: int = 1) -> tuple[DataFrame, DataFrame]:
    """Points with path (a string of 0 and 1), and the splits (path, axis, mid, n) made on the way.

    Each level splits every node of more than ``leaf_size`` points on the next axis: values up to
    mid go left (0), ties included. One aggregation a level; the splits of a level are joined back
    by path. Lineage is cut every four levels.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    now, splits = points.withColumn("path", F.lit("")), []
    for depth in range(max_depth):
        axis = axes[depth % len(axes)]
        level = _splits(now.where(F.length("path") == depth), axis, method).where(F.col("n") > leaf_size).select("path", "mid", "n")
        splits.append(level.select("path", F.lit(axis).alias("axis"), "mid", "n"))
        now = now.join(level.select("path", "mid"), "path", "left")
        step = F.when(F.col("mid").isNull(), "").when(F.col(axis) > F.col("mid"), "1").otherwise("0")
        now = now.withColumn("path", F.concat("path", step)).drop("mid")
        if depth % 4 == 3 and depth + 1 < max_depth:
            now = cut(now)
    return now, reduce(DataFrame.unionByName, splits)


def kd_probe(points: DataFrame, splits: DataFrame, axes: list[str], max_depth: int) -> DataFrame:
    """Adds path: the leaf of a built tree that each point falls in. One join a level."""
    now = points.withColumn("path", F.lit(""))
    for depth in range(max_depth):
        axis = axes[depth % len(axes)]
        level = splits.where(F.length("path") == depth).select("path", "mid")
        step = F.when(F.col("mid").isNull(), "").when(F.col(axis) > F.col("mid"), "1").otherwise("0")
        now = now.join(level, "path", "left").withColumn("path", F.concat("path", step)).drop("mid")
    return now


def kd_encode(splits: DataFrame) -> DataFrame:
    """Splits as (key, node): a path and its axis, plane and size as JSON, which any store of strings holds."""
    return splits.select(F.col("path").alias("key"), F.to_json(F.struct("axis", "mid", "n")).alias("node"))


def kd_rebuild(nodes: DataFrame) -> DataFrame:
    """The splits that ``kd_encode`` wrote; nodes that cannot be read are left out."""
    node = F.from_json("node", "axis string, mid double, n long")
    return nodes.select(F.col("key").alias("path"), node.alias("s")).where("s.mid is not null").select("path", "s.*")


def _axis_value(axes: list[str]) -> Column:
    """The value on the axis that a point's node is split on: axes take turns with the depth."""
    return F.element_at(F.array(*axes), (F.length("path") % len(axes) + 1).cast("int"))


def kd_insert(points: DataFrame, splits: DataFrame, new: DataFrame, axes: list[str], method: str = "median", max_depth: int = 16, leaf_size: int = 1) -> tuple[DataFrame, DataFrame]:
    """A built tree (points with path, splits) with the points of ``new`` in it: points and splits as of ``kd_tree``.

    New points go down the splits to a leaf. A leaf of more than ``leaf_size`` points is split again
    on its next axis, over old and new points alike, and so are its parts, down to ``max_depth``;
    leaves of points that are all equal stay. All other leaves are only counted. One aggregation a
    round, for all leaves to be split at once, whatever their depth.
    """
    made = splits.agg(F.max(F.length("path"))).first()[0]
    placed = kd_probe(new, splits, axes, 0 if made is None else made + 1)
    columns = points.columns
    now, found = cut(points.unionByName(placed.select(*columns))), [splits]
    while True:
        where = F.struct(*axes)
        sizes = now.groupBy("path").agg(F.count("*").alias("n"), F.min(where).alias("a"), F.max(where).alias("z"))
        full = cut(sizes.where((F.col("n") > leaf_size) & (F.length("path") < max_depth) & (F.col("a") != F.col("z"))).select("path"))
        if not full.limit(1).count():
            return now, reduce(DataFrame.unionByName, found)
        value = now.join(full, "path", "left_semi").select("path", _axis_value(axes).alias("value"))
        level = cut(_splits(value, "value", method).select("path", "mid", "n"))
        axis = F.element_at(F.array(*map(F.lit, axes)), (F.length("path") % len(axes) + 1).cast("int"))
        found.append(level.select("path", axis.alias("axis"), "mid", "n"))
        step = F.when(F.col("mid").isNull(), "").when(_axis_value(axes) > F.col("mid"), "1").otherwise("0")
        now = cut(now.join(level.select("path", "mid"), "path", "left").withColumn("path", F.concat("path", step)).select(*columns))


def sparse_kd_tree(points: DataFrame, axes: list[str], method: str = "middle", depth: int = 8) -> tuple[DataFrame, DataFrame]:
    """Points with path and splits (path, axis, mid, n) of a tree whose leaves all lie at ``depth``.

    The first level of each axis is one split for all nodes, made of the whole column, so that cells
    share their planes; its path is ``?`` for every step. Deeper levels split each node that has
    points, even a single one.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    now, splits = points.withColumn("path", F.lit("")), []
    for k in range(depth):
        axis = axes[k % len(axes)]
        whole = k < len(axes)
        level = _splits(now.withColumn("path", F.lit("?" * k)) if whole else now, axis, method).select("path", F.coalesce("mid", "hi").alias("mid"), "n")
        splits.append(level.select("path", F.lit(axis).alias("axis"), "mid", "n"))
        mids = F.broadcast(level.select("mid")) if whole else level.select("path", "mid")
        now = (now.crossJoin(mids) if whole else now.join(mids, "path")).withColumn("path", F.concat("path", F.when(F.col(axis) > F.col("mid"), "1").otherwise("0"))).select(*points.columns, "path")
        if k % 4 == 3:
            now = cut(now)
    return now, reduce(DataFrame.unionByName, splits)


def sparse_kd_insert(points: DataFrame, splits: DataFrame, new: DataFrame, axes: list[str], depth: int = 8) -> DataFrame:
    """The points of a sparse tree and of ``new``, with path. No node is split again; below a node that had no points, new ones go left."""
    now = new.withColumn("path", F.lit(""))
    for k in range(depth):
        axis = axes[k % len(axes)]
        whole = k < len(axes)
        level = splits.where(F.length("path") == k).select("path", "mid")
        now = now.crossJoin(F.broadcast(level.select("mid"))) if whole else now.join(level, "path", "left")
        now = now.withColumn("path", F.concat("path", F.when(F.col(axis) > F.col("mid"), "1").otherwise("0"))).drop("mid")
    return points.unionByName(now.select(*points.columns))


def under(points: DataFrame, key: str) -> DataFrame:
    """All points under a path prefix."""
    return points.where(F.col("path").startswith(key))


def leaf_stats(points: DataFrame, axes: list[str]) -> DataFrame:
    """Per path: n, volume = (product of ranges) ** (2 / number of axes), a range of 0 counting as .001, and density = n / volume."""
    ranges = [(F.max(a) - F.min(a)) for a in axes]
    product = reduce(lambda x, y: x * y, (F.when(r == 0, 0.001).otherwise(r) for r in ranges))
    volume = F.pow(product, F.lit(2.0 / len(axes)))
    return points.groupBy("path").agg(F.count("*").alias("n"), volume.alias("volume")).withColumn("density", F.col("n") / F.col("volume"))


def grid_cell(values: list[Column], splits: list[Column | float]) -> Column:
    """Cell of a grid of half spaces: the sum of 2 ** i for every x_i > split_i."""
    return reduce(lambda a, b: a + b, (F.when(x > s, 1 << i).otherwise(0) for i, (x, s) in enumerate(zip(values, splits))))


def in_region(cell: Column, mask: list[int]) -> Column:
    """Whether a cell fits a mask of 1 (above), 0 (below) and -1 (either) by axis."""
    care = sum(1 << i for i, m in enumerate(mask) if m >= 0)
    return cell.bitwiseAND(F.lit(care)) == sum(1 << i for i, m in enumerate(mask) if m == 1)


def overlaps(a: DataFrame, b: DataFrame, on: str, left: str, right: str) -> DataFrame:
    """Number of common points of each pair of cells of two partitions."""
    return a.select(on, left).join(b.select(on, right), on).groupBy(left, right).agg(F.count("*").alias("n"))


def reweight(pairs: DataFrame, left: str, right: str, weights_a: DataFrame, weights_b: DataFrame, rule: str = "product") -> DataFrame:
    """For overlapping cells (left, right, n), gamma of the cells' weights (product, mean or sum), normalised over each right cell."""
    a, b = F.col("wa"), F.col("wb")
    gamma = {"product": a * b, "mean": (a + b) / 2, "sum": a + b}[rule]
    out = pairs.join(weights_a.withColumnRenamed("w", "wa"), left).join(weights_b.withColumnRenamed("w", "wb"), right).withColumn("gamma", gamma)
    return out.withColumn("p", F.try_divide(F.col("gamma"), F.sum("gamma").over(Window.partitionBy(right))))


def pairwise(rows: DataFrame, name: str, vector: str, within: str | None = None) -> DataFrame:
    """Distances of all pairs a < b of rows, of one group each if ``within`` is given; meant for groups of bounded size."""
    a, b = rows.alias("a"), rows.alias("b")
    test = F.col(f"a.{name}") < F.col(f"b.{name}")
    if within:
        test = test & (F.col(f"a.{within}") == F.col(f"b.{within}"))
    keep = [F.col(f"a.{within}")] if within else []
    return a.join(b, test).select(*keep, F.col(f"a.{name}").alias("a"), F.col(f"b.{name}").alias("b"), vec.distance(F.col(f"a.{vector}"), F.col(f"b.{vector}")).alias("d"))


def nearest_rows(rows: DataFrame, queries: DataFrame, name: str, vector: str, k: int) -> DataFrame:
    """The k nearest rows of each query (query, name, d, rank), exactly, nearest first and lower names first among equals.

    Rows and queries are dealt to blocks, each block of queries meets each block of rows in one matrix product, and only a
    block's best k of a query are shuffled. Rows without a vector are near nothing.
    """
    held, asked = (df.where(F.size(vector) > 0).select(F.col(name).alias("name"), F.col(vector).alias("v")) for df in (rows, queries))
    n, size = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    kind = rows.schema[name].dataType.simpleString()
    found = blocks.met(held, asked, "name", max(1, -(-n * (64 + 8 * (size or 0)) // QUERY_BYTES)), blocks.nearest(k), f"query {kind}, name {kind}, d double")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d", "name")))
    return best.where(F.col("rank") <= k).select("query", F.col("name").alias(name), "d", "rank")


def shared_cells(members: DataFrame, point: str, cell: str, least: int = 3) -> DataFrame:
    """Pairs of cells a < b with at least ``least`` common points: the first level of a multiway subspace join."""
    a, b = members.alias("a"), members.alias("b")
    pairs = a.join(b, (F.col(f"a.{point}") == F.col(f"b.{point}")) & (F.col(f"a.{cell}") < F.col(f"b.{cell}")))
    return pairs.groupBy(F.col(f"a.{cell}").alias("a"), F.col(f"b.{cell}").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def collapse_join(views: list[DataFrame], point: str, cell: str, least: int = 3) -> DataFrame:
    """Joins views (point, cell) two and two, level by level, until one is left; a combined cell stays if it holds at least ``least`` points."""
    level = [v.select(point, F.col(cell).cast("string").alias(cell)) for v in views]
    while len(level) > 1:
        following = []
        for k in range(0, len(level) - 1, 2):
            both = level[k].withColumnRenamed(cell, "a").join(level[k + 1].withColumnRenamed(cell, "b"), point)
            both = both.select(point, F.concat_ws("/", "a", "b").alias(cell)).distinct()
            big = both.groupBy(cell).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(cell)
            following.append(both.join(big, cell, "left_semi").select(point, cell))
        level = following + level[len(level) - len(level) % 2 :]
    return level[0]
