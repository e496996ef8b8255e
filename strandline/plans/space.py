"""Trees, grids, cells, neighbours and projections over embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import blocks, learning, spatial as op
from .tables import LONG, axes, frames, rounded

DEPTH, AXES = 3, ["x0", "x1", "x2"]


def _tree(spark: SparkSession, sf: str, method: str) -> DataFrame:
    points, _ = op.kd_tree(axes(frames(spark, sf), 3), AXES, method, DEPTH)
    return rounded(op.leaf_stats(points, AXES).select("path", "n", "volume"), 5)


def kd_tree_leaves_median(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf, "median")


def kd_tree_leaves_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf, "mean")


def kd_tree_leaves_middle(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf, "middle")


def kd_tree_leaves_max_gap(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf, "max_gap")


def kd_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Points of odd ids in the leaves of a tree of those of even ids."""
    points = axes(frames(spark, sf), 3)
    _, splits = op.kd_tree(points.where("vec_id % 2 = 0"), AXES, "middle", DEPTH)
    return op.kd_probe(points.where("vec_id % 2 = 1"), splits, AXES, DEPTH).select("vec_id", "path")


def kd_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Points of odd ids in the leaves of a tree that was written as strings and built again."""
    points = axes(frames(spark, sf), 3)
    _, splits = op.kd_tree(points.where("vec_id % 2 = 0"), AXES, "middle", DEPTH)
    return op.kd_probe(points.where("vec_id % 2 = 1"), op.kd_rebuild(op.kd_encode(splits)), AXES, DEPTH).select("vec_id", "path")


def kd_subtree(spark: SparkSession, sf: str) -> DataFrame:
    points, _ = op.kd_tree(axes(frames(spark, sf), 3), AXES, "middle", DEPTH)
    return op.under(points, "01").select("vec_id", "path")


#: Of the tree with insertion: depth of the first build, greatest depth, and size of a leaf. Depth of the sparse tree.
BUILT, DEEPEST, LEAF, SPARSE = 3, 8, 12, 5


def kd_insert(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of the points of even ids, into which those of odd ids are put: the leaf of every point."""
    points = axes(frames(spark, sf), 3)
    tree, splits = op.kd_tree(points.where("vec_id % 2 = 0"), AXES, "middle", BUILT, LEAF)
    return op.kd_insert(tree, splits, points.where("vec_id % 2 = 1"), AXES, "middle", DEEPEST, LEAF)[0].select("vec_id", "path")


def kd_insert_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The splits that a second batch of points adds to a tree."""
    points = axes(frames(spark, sf), 3)
    tree, splits = op.kd_tree(points.where("vec_id % 2 = 0"), AXES, "middle", BUILT, LEAF)
    made = op.kd_insert(tree, splits, points.where("vec_id % 2 = 1"), AXES, "middle", DEEPEST, LEAF)[1]
    return rounded(made.join(splits.select("path"), "path", "left_anti").select("path", "axis", "mid", "n"))


def sparse_kd_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves of a sparse tree of the points of even ids with those of odd ids put in: all at one depth."""
    points = axes(frames(spark, sf), 3)
    tree, splits = op.sparse_kd_tree(points.where("vec_id % 2 = 0"), AXES, "middle", SPARSE)
    return op.sparse_kd_insert(tree, splits, points.where("vec_id % 2 = 1"), AXES, SPARSE).select("vec_id", "path")


def kd_grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    p = axes(frames(spark, sf), 10)
    return rounded(p.groupBy(op.grid_cell([F.col(f"x{k}") for k in range(10)], [0.0] * 10).alias("cell")).agg(F.count("*").alias("n")))


def kd_region_count(spark: SparkSession, sf: str) -> DataFrame:
    masks = {"a": [1, 1, -1, -1, -1], "b": [0, -1, 1, -1, -1], "c": [-1, -1, 0, 0, 1]}
    p = axes(frames(spark, sf), 5).withColumn("cell", op.grid_cell([F.col(f"x{k}") for k in range(5)], [0.0] * 5))
    return reduce(DataFrame.unionByName, [p.where(op.in_region(F.col("cell"), m)).agg(F.lit(r).alias("region"), F.count("*").alias("n")) for r, m in masks.items()])


def _cells(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = axes(frames(spark, sf), 6)
    return (p.select("vec_id", op.grid_cell([F.col(f"x{k}") for k in ks], [0.0] * 3).cast("long").alias(name)) for ks, name in (((0, 1, 2), "a"), ((3, 4, 5), "b")))


def cell_overlap(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _cells(spark, sf)
    return op.overlaps(a, b, "vec_id", "a", "b")


def reweight_edges(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _cells(spark, sf)
    wa = a.groupBy("a").agg(F.count("*").cast("double").alias("w"))
    wb = b.groupBy("b").agg(F.count("*").cast("double").alias("w"))
    return rounded(op.reweight(op.overlaps(a, b, "vec_id", "a", "b"), "a", "b", wa, wb, "product").select("a", "b", "n", "gamma", "p"))


def explore_exploit_pdf(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _cells(spark, sf)
    wa = a.groupBy("a").agg((1 / F.count("*")).alias("w"))
    wb = b.groupBy("b").agg((1 / F.count("*")).alias("w"))
    out = op.reweight(op.overlaps(a, b, "vec_id", "a", "b"), "a", "b", wa, wb, "mean")
    return rounded(out.groupBy("a").agg(F.sum("p").alias("p")))


def pairwise_distance_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Number, mean and extremes of the distances of all pairs within each label."""
    return rounded(blocks.pair_statistics(frames(spark, sf), "vec_id", "x", "label"))


def knn_exact_top5(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    return rounded(op.nearest_rows(f, f.where("vec_id % 50 = 0"), "vec_id", "x", 5).select("query", "vec_id", "d", "rank"))


def multiway_subspace_join(spark: SparkSession, sf: str) -> DataFrame:
    p = axes(frames(spark, sf), 8)
    views = [p.select("vec_id", op.grid_cell([F.col(f"x{2 * k}"), F.col(f"x{2 * k + 1}")], [0.0, 0.0]).alias("cell")) for k in range(4)]
    return op.collapse_join(views, "vec_id", "cell").groupBy("cell").agg(F.count("*").alias("n"))


def common_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of on-dimensions that at least 20 vectors share."""
    on = frames(spark, sf).select("vec_id", F.posexplode("x").alias("cell", "v")).where("v > 0.2").select("vec_id", "cell")
    return rounded(op.shared_cells(on, "vec_id", "cell", 5))


def covariance_cells(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    both = learning.merge_moments(learning.moments(f.where("vec_id % 2 = 0"), "x"), learning.moments(f.where("vec_id % 2 = 1"), "x"))
    return rounded(learning.covariance(both))


def fixed_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Projection of the vectors on two given directions."""
    parts = [[1.0 if k % 2 == 0 else -1.0 for k in range(64)], [k / 64 for k in range(64)]]
    out = learning.project(frames(spark, sf), "x", parts, [0.0] * 64)
    return rounded(out.select("vec_id", F.get("pc", 0).alias("p0"), F.get("pc", 1).alias("p1")))


def pca_project(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    parts, means, _ = learning.pca(f, "x", 2)
    return rounded(learning.project(f, "x", parts, means).select("vec_id", F.get("pc", 0).alias("pc0"), F.get("pc", 1).alias("pc1")), 4)


def kmeans_clusters(spark: SparkSession, sf: str) -> DataFrame:
    out, _, _ = learning.kmeans(frames(spark, sf), "x", 10)
    return rounded(out.groupBy("cluster", "label").agg(F.count("*").alias("n")))


def gap_statistic(spark: SparkSession, sf: str) -> DataFrame:
    """Gap statistic of the vectors for up to twelve clusters, against four uniform tables, and the number chosen."""
    out, best = learning.gap_statistic(frames(spark, sf), "x", 12, 4, rounds=5)
    return rounded(out.withColumn("best", F.lit(best)), 4)


def kernel_pca(spark: SparkSession, sf: str) -> DataFrame:
    """Two components of all vectors by a kernel PCA on landmarks."""
    f = frames(spark, sf)
    model = learning.kernel_pca(f, "vec_id", "x", 2, gamma=1.0)
    return rounded(learning.project_kernel(f, "x", model).select("vec_id", F.get("kpc", 0).alias("k0"), F.get("kpc", 1).alias("k1")), 4)


def gmm_weights(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = learning.mixture(frames(spark, sf), "x", 3)
    return rounded(out.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(F.array_max("probability")).alias("certainty")), 4)


def lsh_votes(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    return rounded(learning.lsh_vote(f, f.where("vec_id % 50 = 0"), "vec_id", "x", "label", 1.2))


def sign_hash_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames(spark, sf).groupBy(learning.sign_bits("x", 6, 64).alias("bucket")).agg(F.count("*").alias("n")))


def norms(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    return rounded(f.select("vec_id", vec.norm(F.col("x")).alias("norm"), F.array_max("x").alias("top"), (F.array_position("x", F.array_max("x")) - 1).alias("argmax")))


QUERIES = {f.__name__: f for f in (kd_tree_leaves_median, kd_tree_leaves_mean, kd_tree_leaves_middle, kd_tree_leaves_max_gap, kd_probe, kd_rebuild, kd_subtree, kd_insert, kd_insert_splits, sparse_kd_tree, kd_grid_cells, kd_region_count, cell_overlap, reweight_edges, explore_exploit_pdf, pairwise_distance_matrix, knn_exact_top5, multiway_subspace_join, common_cells, covariance_cells, fixed_projection, pca_project, kmeans_clusters, gap_statistic, kernel_pca, gmm_weights, lsh_votes, sign_hash_buckets, norms)}


def _levels(mid: str, source: str = "p") -> str:
    """The levels of a tree in SQL; mid is an aggregate of {x}."""
    out, now = [], "t0"
    head = f"t0 AS (SELECT *, '' AS path FROM {source})"
    for k in range(DEPTH):
        m = mid.format(x=f"x{k}")
        out.append(f"m{k} AS (SELECT path, {m} AS mid FROM t{k} GROUP BY path HAVING count(*) > 1)")
        out.append(f"t{k + 1} AS (SELECT t.* EXCLUDE (path), t.path || CASE WHEN m.mid IS NULL THEN '' WHEN t.x{k} > m.mid THEN '1' ELSE '0' END AS path FROM t{k} t LEFT JOIN m{k} m USING (path))")
        now = f"t{k + 1}"
    return ", ".join([head, *out]), now


def _gap_levels() -> tuple[str, str]:
    out = ["t0 AS (SELECT *, '' AS path FROM p)"]
    for k in range(DEPTH):
        out.append(f"g{k} AS (SELECT path, x{k} AS x, lead(x{k}) OVER (PARTITION BY path ORDER BY x{k}) - x{k} AS gap FROM t{k}), o{k} AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY coalesce(gap, -1) DESC, x) AS r, count(*) OVER (PARTITION BY path) AS n FROM g{k})")
        out.append(f"m{k} AS (SELECT path, x + gap / 2 AS mid FROM o{k} WHERE r = 1 AND n > 1)")
        out.append(f"t{k + 1} AS (SELECT t.* EXCLUDE (path), t.path || CASE WHEN m.mid IS NULL THEN '' WHEN t.x{k} > m.mid THEN '1' ELSE '0' END AS path FROM t{k} t LEFT JOIN m{k} m USING (path))")
    return ", ".join(out), f"t{DEPTH}"


_MID = "(max(x{k}) + min(x{k})) / 2"


def _step(to: str, source: str, mids: str, axis: int) -> str:
    return f"{to} AS (SELECT t.* EXCLUDE (path), t.path || CASE WHEN m.mid IS NULL THEN '' WHEN t.x{axis} > m.mid THEN '1' ELSE '0' END AS path FROM {source} t LEFT JOIN {mids} m USING (path))"


def _insert_levels() -> str:
    """u<DEEPEST>: all points with their leaves; v<k>: the splits that the second batch made at depth k."""
    out = ["a0 AS (SELECT *, '' AS path FROM p WHERE vec_id % 2 = 0), b0 AS (SELECT *, '' AS path FROM p WHERE vec_id % 2 = 1)"]
    for k in range(BUILT):
        out += [f"m{k} AS (SELECT path, {_MID.format(k=k)} AS mid FROM a{k} WHERE length(path) = {k} GROUP BY path HAVING count(*) > {LEAF})", _step(f"a{k + 1}", f"a{k}", f"m{k}", k), _step(f"b{k + 1}", f"b{k}", f"m{k}", k)]
    out.append(f"u0 AS (SELECT * FROM a{BUILT} UNION ALL SELECT * FROM b{BUILT})")
    for k in range(DEEPEST):
        out += [f"v{k} AS (SELECT path, {_MID.format(k=k % 3)} AS mid, count(*) AS n FROM u{k} WHERE length(path) = {k} GROUP BY path HAVING count(*) > {LEAF})", _step(f"u{k + 1}", f"u{k}", f"v{k}", k % 3)]
    return ", ".join(out)


def _sparse_levels() -> str:
    out = ["a0 AS (SELECT *, '' AS path FROM p WHERE vec_id % 2 = 0), b0 AS (SELECT *, '' AS path FROM p WHERE vec_id % 2 = 1)"]
    for k in range(SPARSE):
        mid = f"(SELECT {_MID.format(k=k)} FROM a0)" if k < 3 else f"(SELECT {_MID.format(k=k % 3)} FROM a{k} WHERE a{k}.path = t.path)"
        out += [f"{t}{k + 1} AS (SELECT t.* EXCLUDE (path), t.path || CASE WHEN t.x{k % 3} > {mid} THEN '1' ELSE '0' END AS path FROM {t}{k} t)" for t in "ab"]
    return ", ".join(out)


_P = "p AS (SELECT vec_id, label, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS x{k}" for k in range(10)) + " FROM embeddings)"
_R = " * ".join(f"(CASE WHEN max(x{k}) = min(x{k}) THEN 0.001::DOUBLE ELSE max(x{k}) - min(x{k}) END)" for k in range(3))


def _leaves(levels: tuple[str, str]) -> str:
    return f"WITH {_P}, {levels[0]} SELECT path, count(*) AS n, round(pow({_R}, 2.0 / 3), 5) AS volume FROM {levels[1]} GROUP BY path"


def _cell(ks) -> str:
    return " + ".join(f"CASE WHEN x{k} > 0 THEN {1 << i} ELSE 0 END" for i, k in enumerate(ks))


_AB = f"{_P}, k AS (SELECT vec_id, ({_cell((0, 1, 2))})::BIGINT AS a, ({_cell((3, 4, 5))})::BIGINT AS b FROM p), o AS (SELECT a, b, count(*) AS n FROM k GROUP BY ALL)"
_GAMMA = "wa AS (SELECT a, {w} AS wa FROM k GROUP BY a), wb AS (SELECT b, {w} AS wb FROM k GROUP BY b), g AS (SELECT a, b, n, {g} AS gamma FROM o JOIN wa USING (a) JOIN wb USING (b)), q AS (SELECT *, gamma / sum(gamma) OVER (PARTITION BY b) AS p FROM g)"
_TREE_PROBE = _levels("(max({x}) + min({x})) / 2", "(SELECT * FROM p WHERE vec_id % 2 = 0)")
ORACLE_SQL = {
    "kd_tree_leaves_median": _leaves(_levels("quantile_cont({x}, 0.5)")),
    "kd_tree_leaves_mean": _leaves(_levels("avg({x})")),
    "kd_tree_leaves_middle": _leaves(_levels("(max({x}) + min({x})) / 2")),
    "kd_tree_leaves_max_gap": _leaves(_gap_levels()),
    "kd_probe": f"WITH {_P}, {_TREE_PROBE[0]}, q0 AS (SELECT *, '' AS path FROM p WHERE vec_id % 2 = 1), " + ", ".join(f"q{k + 1} AS (SELECT q.* EXCLUDE (path), q.path || CASE WHEN m.mid IS NULL THEN '' WHEN q.x{k} > m.mid THEN '1' ELSE '0' END AS path FROM q{k} q LEFT JOIN m{k} m USING (path))" for k in range(DEPTH)) + f" SELECT vec_id, path FROM q{DEPTH}",
    "kd_subtree": f"WITH {_P}, {_levels('(max({x}) + min({x})) / 2')[0]} SELECT vec_id, path FROM t{DEPTH} WHERE path LIKE '01%'",
    "kd_insert": f"WITH {_P}, {_insert_levels()} SELECT vec_id, path FROM u{DEEPEST}",
    "kd_insert_splits": f"WITH {_P}, {_insert_levels()} " + " UNION ALL ".join(f"SELECT path, 'x{k % 3}' AS axis, round(mid, 6) AS mid, n FROM v{k}" for k in range(DEEPEST)),
    "sparse_kd_tree": f"WITH {_P}, {_sparse_levels()} SELECT vec_id, path FROM a{SPARSE} UNION ALL SELECT vec_id, path FROM b{SPARSE}",
    "kd_grid_cells": f"WITH {_P} SELECT ({_cell(range(10))})::BIGINT AS cell, count(*) AS n FROM p GROUP BY 1",
    "kd_region_count": f"WITH {_P} SELECT 'a' AS region, count(*) AS n FROM p WHERE x0 > 0 AND x1 > 0 UNION ALL SELECT 'b', count(*) FROM p WHERE x0 <= 0 AND x2 > 0 UNION ALL SELECT 'c', count(*) FROM p WHERE x2 <= 0 AND x3 <= 0 AND x4 > 0",
    "cell_overlap": f"WITH {_AB} SELECT a, b, n FROM o",
    "reweight_edges": f"WITH {_AB}, {_GAMMA.format(w='count(*)::DOUBLE', g='wa * wb')} SELECT a, b, n, round(gamma, 6) AS gamma, round(p, 6) AS p FROM q",
    "explore_exploit_pdf": f"WITH {_AB}, {_GAMMA.format(w='1.0::DOUBLE / count(*)', g='(wa + wb) / 2')} SELECT a, round(sum(p), 6) AS p FROM q GROUP BY a",
    "pairwise_distance_matrix": f"WITH {LONG}, d AS (SELECT a.label, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d FROM x a JOIN x b ON a.i = b.i AND a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label, a.vec_id, b.vec_id) SELECT label::BIGINT AS label, count(*) AS n, round(avg(d), 6) AS mean, round(min(d), 6) AS least, round(max(d), 6) AS most FROM d GROUP BY 1",
    "knn_exact_top5": f"WITH {LONG}, d AS (SELECT q.vec_id AS query, x.vec_id, sqrt(sum((q.v - x.v) * (q.v - x.v))) AS d FROM x q JOIN x ON q.i = x.i AND q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS rank FROM d) SELECT query, vec_id, round(d, 6) AS d, rank FROM r WHERE rank <= 5",
    "multiway_subspace_join": f"""WITH {_P}, v AS (SELECT vec_id, """ + ", ".join(f"({_cell((2 * k, 2 * k + 1))})::VARCHAR AS c{k}" for k in range(4)) + """ FROM p), l AS (SELECT vec_id, c0 || '/' || c1 AS l, c2 || '/' || c3 AS r FROM v),
        f AS (SELECT * FROM l WHERE l IN (SELECT l FROM l GROUP BY l HAVING count(*) >= 3) AND r IN (SELECT r FROM l GROUP BY r HAVING count(*) >= 3)) SELECT l || '/' || r AS cell, count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= 3""",
    "common_cells": f"WITH {LONG}, o AS (SELECT vec_id, i FROM x WHERE v > 0.2) SELECT a.i AS a, b.i AS b, count(*) AS n FROM o a JOIN o b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY ALL HAVING count(*) >= 5",
    "covariance_cells": f"WITH {LONG} SELECT a.i, b.i AS j, round(covar_samp(a.v, b.v), 6) AS c FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL",
    "fixed_projection": f"WITH {LONG} SELECT vec_id, round(sum(CASE WHEN i % 2 = 0 THEN v ELSE -v END), 6) AS p0, round(sum(v * i / 64.0::DOUBLE), 6) AS p1 FROM x GROUP BY 1",
    "norms": f"WITH {LONG} SELECT vec_id, round(sqrt(sum(v * v)), 6) AS norm, round(max(v), 6) AS top, arg_max(i, v) AS argmax FROM x GROUP BY 1",
}
ORACLE_SQL["kd_rebuild"] = ORACLE_SQL["kd_probe"]
