"""Models and samples against numpy, enumeration and planted truths."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandline.operators import learning, sampling, stats


def clusters(spark, k, n=40, d=4, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.permutation(np.array(list(itertools.product((0.0, 10.0), repeat=d))))[:k]
    x = np.concatenate([c + rng.normal(size=(n, d)) for c in centres])
    return x, spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")


@pytest.mark.parametrize("k", [1, 3])
def test_gap_statistic_finds_planted_clusters(spark, k):
    x, rows = clusters(spark, k)
    found, best = learning.gap_statistic(rows, "x", 5, copies=4)
    assert best == k
    got = {r["k"]: r for r in found.collect()}
    assert got[1]["cost"] == pytest.approx(((x - x.mean(0)) ** 2).sum()) and got[1]["f"] == 1.0
    assert got[1]["log_w"] == pytest.approx(np.log(((x - x.mean(0)) ** 2).sum() / 8))
    if k == 3:
        planted = sum(((x[i : i + 40] - x[i : i + 40].mean(0)) ** 2).sum() for i in range(0, 120, 40))
        assert got[3]["cost"] == pytest.approx(planted)
        assert min(got, key=lambda j: got[j]["f"]) == 3


def test_uniform_copies_fill_the_ranges(spark):
    x, rows = clusters(spark, 3)
    made = learning._uniform_copies(rows, "x", 400, 2, 1).collect()
    for part in (1, 2):
        u = np.array([r["v"] for r in made if r["part"] == part])
        assert u.shape == (400, 4) and (u >= x.min(0)).all() and (u <= x.max(0)).all()
        assert np.abs(u.mean(0) - (x.min(0) + x.max(0)) / 2).max() < 1.2
        assert np.abs(np.corrcoef(u.T) - np.eye(4)).max() < 0.2


@pytest.mark.parametrize("kind", ["rbf", "poly", "cosine", "sigmoid"])
def test_kernel_pca_equals_numpy(spark, kind):
    x, rows = clusters(spark, 3, n=15)
    rows = rows.withColumn("x", F.transform("x", lambda v: v / 10))
    model = learning.kernel_pca(rows, "id", "x", 2, 0.7, kind)
    got = {r["id"]: r["kpc"] for r in learning.project_kernel(rows.union(spark.createDataFrame([(-1, None)], rows.schema)), "x", model).collect()}
    assert got.pop(-1) is None
    y = np.array([got[i] for i in range(len(x))])
    gram = learning._kernel(x / 10, x / 10, 0.7, kind)
    n = len(x)
    h = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(h @ gram @ h)
    want = vectors[:, ::-1][:, :2] * np.sqrt(values[::-1][:2])
    for c in range(2):
        assert min(np.abs(y[:, c] - want[:, c]).max(), np.abs(y[:, c] + want[:, c]).max()) < 1e-6


def test_kernel_pca_on_landmarks_covers_every_row(spark):
    x, rows = clusters(spark, 3, n=40)
    exact = np.array([r["kpc"] for r in learning.project_kernel(rows, "x", learning.kernel_pca(rows, "id", "x", 2, 0.02)).orderBy("id").collect()])
    some = np.array([r["kpc"] for r in learning.project_kernel(rows, "x", learning.kernel_pca(rows, "id", "x", 2, 0.02, most=45)).orderBy("id").collect()])
    assert some.shape == exact.shape
    assert all(abs(np.corrcoef(exact[:, c], some[:, c])[0, 1]) > 0.9 for c in range(2)) or abs(np.linalg.det(np.corrcoef(exact.T, some.T)[:2, 2:])) > 0.8


def test_lsh_finds_what_exact_search_finds(spark, sf):
    """Recall within the radius, of the neighbours by all distances."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    x = {r["vec_id"]: np.array(r["x"]) for r in rows.collect()}
    asked = [k for k in x if k % 10 == 0]
    true = {(a, b) for a in asked for b in x if a != b and np.linalg.norm(x[a] - x[b]) < 1.2}
    got = {(r["query"], r["vec_id"]) for r in learning.lsh_neighbours(rows, rows.where("vec_id % 10 = 0"), "vec_id", "x", 1.2).collect()}
    assert got <= true | {(a, b) for a, b in got if np.linalg.norm(x[a] - x[b]) <= 1.2 + 1e-9}
    assert len(true) > 20 and len(got & true) >= 0.9 * len(true)


def test_running_total_over_many_ranges(spark):
    rng = random.Random(1)
    data = [(k, rng.randint(0, 5), rng.random()) for k in range(300)]
    rows = spark.createDataFrame(data, "id long, size int, score double").repartition(7)
    got = {r["id"]: r["filled"] for r in sampling.running_total(rows, [F.desc("size"), F.asc("id")], F.col("score"), "filled").collect()}
    total = 0.0
    for k, _, s in sorted(data, key=lambda r: (-r[1], r[0])):
        total += s
        assert got[k] == pytest.approx(total)


def test_exchanges_reach_the_optimum_and_never_fall_behind(spark):
    for seed in range(3):
        rng = random.Random(seed)
        items = {k: [rng.randint(0, 9) * 1.0, rng.randint(0, 9) * 1.0] for k in range(12)}
        rows = spark.createDataFrame(list(items.items()), "id long, v array<double>")
        planted = rng.sample(range(12), 3)
        goal = [sum(items[k][c] for k in planted) for c in range(2)]
        first = spark.createDataFrame([(k,) for k in range(3)], "id long")
        found, before, after = sampling.knapsack_oscillate(rows, first, "id", "v", goal)
        ids = [r["id"] for r in found.collect()]
        miss = lambda s: sum(abs(g - sum(items[k][c] for k in s)) for c, g in enumerate(goal))
        assert len(set(ids)) == 3 and after == pytest.approx(miss(ids)) and before == pytest.approx(miss(range(3))) and after <= before
        assert all(miss([x for x in ids if x != a] + [b]) >= after - 1e-9 for a in ids for b in items if b not in ids)
    easy = spark.createDataFrame([(k, [float(2**k)]) for k in range(6)], "id long, v array<double>")
    assert sampling.knapsack_oscillate(easy, easy.where("id < 2").select("id"), "id", "v", [40.0])[2] == 0.0


def test_explorer_draws_follow_weights_and_stop_at_exhausted_clusters(spark):
    members = spark.createDataFrame([(c, c * 1000 + r, r) for c, n in ((0, 400), (1, 400), (2, 3)) for r in range(1, n + 1)], "cluster long, id long, rank int")
    weights = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 50.0), (3, 0.0)], "cluster long, w double")
    rows = sampling.explorer_draws(members, weights, "cluster", "rank", 300).collect()
    count = {c: sum(r["cluster"] == c for r in rows) for c in range(4)}
    assert count[2] == 3 and count[3] == 0 and sum(count.values()) == 300
    assert 2.2 < count[1] / count[0] < 4.2
    assert all(sorted(r["rank"] for r in rows if r["cluster"] == c) == list(range(1, count[c] + 1)) for c in range(3))
    assert sampling.explorer_draws(members, weights, "cluster", "rank", 2000).count() == 803


def test_resampled_intervals_cover(spark):
    """Means of normal samples, their deviation and covariance as theory has them."""
    rng = np.random.default_rng(2)
    a = rng.normal(5, 2, 2000)
    b = 0.5 * a + rng.normal(0, 1, 2000)
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "id long, a double, b double")
    got = {r["feature"]: r for r in stats.bootstrap_param(rows, "id", ["a", "b"], 60).collect()}
    assert got["a"]["mean"] == pytest.approx(a.mean()) and got["a"]["sigma"] == pytest.approx(a.std() / np.sqrt(2000), rel=0.3)
    wide = {r["feature"]: r for r in stats.bootstrap_replacement(rows, "id", ["a"], samples=60, bounds=(2000, 2000)).collect()}["a"]
    assert wide["lo"] < 0 < wide["hi"] and wide["hi"] - wide["lo"] == pytest.approx(2 * 1.645 * a.std() / np.sqrt(2000), rel=0.4)
    own, cov = stats.bootstrap_mv(rows, "id", ["a", "b"], 80)
    c = {(r["a"], r["b"]): r["c"] for r in cov.collect()}
    assert c["a", "b"] / np.sqrt(c["a", "a"] * c["b", "b"]) == pytest.approx(np.corrcoef(a, b)[0, 1], abs=0.15)
    assert abs({r["feature"]: r for r in own.collect()}["b"]["mean"] - b.mean()) < 0.02


@pytest.mark.parametrize("rate", [0.1, 1.0, 10.0])
def test_draws_are_poisson(spark, rate):
    rows = spark.range(20_000).select(stats.draws(F.col("id"), F.lit(3), rate).alias("t"))
    mean, var = rows.agg(F.avg("t"), F.var_pop("t")).first()
    assert mean == pytest.approx(rate, rel=0.05) and var == pytest.approx(rate, rel=0.08)
