"""Queries that have no SQL twin, against numpy and what must hold of their results."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandline.operators import lattice, learning
from strandline.registry import QUERIES


@pytest.fixture(scope="module")
def vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["embedding"] for r in rows], float), [r["vec_id"] for r in rows], [r["label"] for r in rows]


def test_pca_project(spark, sf, vectors):
    x, ids, _ = vectors
    values, parts = np.linalg.eigh(np.cov(x.T))
    want = (x - x.mean(0)) @ parts[:, ::-1][:, :2]
    got = {r["vec_id"]: (r["pc0"], r["pc1"]) for r in QUERIES["pca_project"](spark, sf).collect()}
    got = np.array([got[i] for i in ids])
    for c in range(2):
        assert min(np.abs(got[:, c] - want[:, c]).max(), np.abs(got[:, c] + want[:, c]).max()) < 1e-3


def test_sign_hash_buckets(spark, sf, vectors):
    planes = np.random.default_rng(1).normal(size=(6, 64))
    bucket = ((vectors[0] @ planes.T) > 0) @ (1 << np.arange(6))
    assert {r["bucket"]: r["n"] for r in QUERIES["sign_hash_buckets"](spark, sf).collect()} == dict(zip(*(a.tolist() for a in np.unique(bucket, return_counts=True))))


def test_kmeans_assigns_to_the_nearest_centre(spark, sf, vectors):
    x, ids, _ = vectors
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    out, centres, cost = learning.kmeans(rows, "x", 10)
    got = {r["vec_id"]: r["cluster"] for r in out.collect()}
    d = ((x[:, None, :] - np.array(centres)[None]) ** 2).sum(2)
    assert [got[i] for i in ids] == d.argmin(1).tolist() and cost == pytest.approx(d.min(1).sum(), rel=1e-6)
    table = QUERIES["kmeans_clusters"](spark, sf).collect()
    assert sum(r["n"] for r in table) == len(ids)


def test_mixture_weights(spark, sf, vectors):
    got = QUERIES["gmm_weights"](spark, sf).collect()
    assert sum(r["n"] for r in got) == len(vectors[1]) and all(1 / 3 <= r["certainty"] <= 1 for r in got)


def test_markov_clusters_part_two_cliques(spark):
    edges = [(a, b, 1.0) for block in (range(4), range(4, 9)) for a in block for b in block if a < b] + [(3, 4, 0.05)]
    got = {r["j"]: r["cluster"] for r in lattice.markov_clusters(spark.createDataFrame(edges, "i int, j int, v double"), rounds=8).collect()}
    assert len({got[k] for k in range(4)}) == 1 == len({got[k] for k in range(4, 9)}) and got[0] != got[8] and len(got) == 9


def test_resampled_shares(spark, sf):
    got = QUERIES["resampled_shares"](spark, sf).collect()
    assert sum(r["p"] for r in got) == pytest.approx(1, abs=1e-4) and all(r["lo"] <= r["p"] <= r["hi"] and r["hi"] - r["lo"] < 0.1 for r in got)


def test_lattice_sample_repeats_no_member(spark, sf):
    got = QUERIES["lattice_sample"](spark, sf).collect()
    assert 0 < len(got) <= 60 and len({r["vec_id"] for r in got}) == len(got) == len({r["draw"] for r in got})
    for label in {r["label"] for r in got}:
        ranks = sorted(r["rank"] for r in got if r["label"] == label)
        assert ranks == list(range(1, len(ranks) + 1))


def test_hierarchical_clusters(spark, sf, vectors):
    got = QUERIES["hierarchical_clusters"](spark, sf).collect()
    assert len(got) == 4 and sum(r["n"] for r in got) == len(vectors[1]) and all(0 <= r["well"] <= 1 for r in got)


def test_exchanged_knapsack(spark, sf):
    got = QUERIES["knapsack_oscillation"](spark, sf).collect()
    part = {r["p_partkey"]: (r["p_size"], r["p_retailprice"] / 100) for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    miss = sum(abs(g - sum(part[r["p_partkey"]][k] for r in got)) for k, g in enumerate((300.0, 110.0)))
    assert len({r["p_partkey"] for r in got}) == 10 and got[0]["after"] == pytest.approx(miss, abs=1e-4) and got[0]["after"] <= got[0]["before"]
