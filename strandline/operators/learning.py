"""Dimensionality reduction and clustering with Spark ML, on array<double> columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..lineage import cut
from ..session import ship
from . import blocks
from .sampling import MODULUS, bottom_k, hash_order

#: Size of a block of queries.
QUERY_BYTES = 64 << 20
#: Rows that kernel PCA is fitted on.
MAX_KERNEL_ROWS = 2_000


def moments(rows: DataFrame, vector: str) -> DataFrame:
    """(i, j, n, s_i, s_j, s_ij) for i <= j: sufficient statistics of a covariance matrix, which add up over batches."""
    v = F.col(vector)
    pairs = F.flatten(F.transform(v, lambda a, i: F.transform(F.slice(v, i + 1, F.size(v)), lambda b, k: F.struct(i.alias("i"), (i + k).alias("j"), a.alias("a"), b.alias("b")))))
    cells = rows.select(F.explode(pairs).alias("p")).select("p.*")
    return cells.groupBy("i", "j").agg(F.count("*").alias("n"), F.sum("a").alias("s_i"), F.sum("b").alias("s_j"), F.sum(F.col("a") * F.col("b")).alias("s_ij"))


def merge_moments(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "s_i", "s_j", "s_ij")))


def covariance(stats: DataFrame) -> DataFrame:
    """(i, j, c): sample covariances of ``moments``."""
    return stats.select("i", "j", ((F.col("s_ij") - F.col("s_i") * F.col("s_j") / F.col("n")) / (F.col("n") - 1)).alias("c"))


def pca(rows: DataFrame, vector: str, k: int) -> tuple[list[list[float]], list[float], list[float]]:
    """(components, means, variances) from the covariance matrix, whose size is the square of the vector's.

    A component's sign is such that its largest element is positive.
    """
    cells = moments(rows, vector).collect()
    size = 1 + max(r["j"] for r in cells)
    c, mean = np.zeros((size, size)), np.zeros(size)
    for r in cells:
        c[r["i"], r["j"]] = c[r["j"], r["i"]] = (r["s_ij"] - r["s_i"] * r["s_j"] / r["n"]) / (r["n"] - 1)
        if r["i"] == r["j"]:
            mean[r["i"]] = r["s_i"] / r["n"]
    values, vectors = np.linalg.eigh(c)
    best = np.argsort(-values, kind="stable")[:k]
    parts = vectors[:, best].T
    parts = parts * np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])[:, None]
    return parts.tolist(), mean.tolist(), values[best].tolist()


def project(rows: DataFrame, vector: str, components: list[list[float]], means: list[float], name: str = "pc") -> DataFrame:
    """Adds an array of the centred vector's products with the components."""
    centred = F.zip_with(vector, F.array(*(F.lit(float(m)) for m in means)), lambda x, m: x - m)
    return rows.withColumn(name, F.array(*(vec.dot(centred, F.array(*(F.lit(float(x)) for x in c))) for c in components)))


@dataclass(frozen=True)
class KernelPca:
    """Landmarks with the coefficients of the components on them, and what centres a kernel row."""

    landmarks: np.ndarray
    coefficients: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    gamma: float
    kind: str


def kernel_pca(rows: DataFrame, row_id: str, vector: str, k: int, gamma: float = 1.0, kind: str = "rbf", most: int = MAX_KERNEL_ROWS) -> KernelPca:
    """Kernel PCA fitted on landmarks: the ``most`` rows of the least hash, which are all rows of a smaller table; kinds: rbf, poly, cosine, sigmoid.

    A component's sign is such that its coefficient of the largest size is positive.
    """
    x = np.array([r[0] for r in rows.orderBy(F.xxhash64(row_id), row_id).limit(most).select(F.col(vector).cast("array<double>")).collect()], float)
    gram = _kernel(x, x, gamma, kind)
    means = gram.mean(axis=0)
    values, vectors = np.linalg.eigh(gram - means[None, :] - means[:, None] + gram.mean())
    best = np.argsort(-values, kind="stable")[:k]
    parts = vectors[:, best] / np.sqrt(np.maximum(values[best], 1e-12))
    parts = parts * np.sign(parts[np.abs(parts).argmax(axis=0), np.arange(parts.shape[1])])
    return KernelPca(x, parts, means, values[best], gamma, kind)


def project_kernel(rows: DataFrame, vector: str, model: KernelPca, name: str = "kpc") -> DataFrame:
    """Adds an array of each row's components: all rows against the landmarks, a block of kernel values at a time. Null vectors stay null."""
    ship(rows.sparkSession)

    def components(vectors: pd.Series) -> pd.Series:
        known = vectors.notna().to_numpy()
        out = np.full(len(vectors), None, dtype=object)
        places = np.flatnonzero(known)
        step = max(1, (1 << 22) // max(1, len(model.landmarks)))
        for at in range(0, len(places), step):
            part = places[at : at + step]
            kernel = _kernel(np.stack(vectors.iloc[part].to_list()).astype(float), model.landmarks, model.gamma, model.kind)
            centred = kernel - kernel.mean(axis=1)[:, None] - model.means[None, :] + model.means.mean()
            out[part] = list(centred @ model.coefficients)
        return pd.Series(out)

    return rows.withColumn(name, F.pandas_udf(components, "array<double>")(F.col(vector).cast("array<double>")))


def _kernel(a: np.ndarray, b: np.ndarray, gamma: float, kind: str) -> np.ndarray:
    dots = a @ b.T
    if kind == "rbf":
        return np.exp(-gamma * ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * dots))
    if kind == "poly":
        return (gamma * dots + 1) ** 3
    if kind == "sigmoid":
        return np.tanh(gamma * dots + 1)
    return dots / np.maximum(np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :], 1e-12)


def kmeans(rows: DataFrame, vector: str, k: int, seed: int = 1, rounds: int = 20):
    """(rows with cluster, centres as lists, cost)."""
    data = rows.withColumn("__v", array_to_vector(vector))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="__v", predictionCol="cluster").fit(data)
    return model.transform(data).drop("__v"), [c.tolist() for c in model.clusterCenters()], model.summary.trainingCost


def classify_scores(rows: DataFrame, near: str, k: int) -> DataFrame:
    """Adds score: min(k, mean of the other distances over the nearest), k where the nearest is 0. ``near`` is sorted (d, state)."""
    nearest = F.get(near, 0)["d"]
    others = F.aggregate(F.slice(near, 2, 1 << 30), F.lit(0.0), lambda s, x: s + x["d"]) / F.greatest(F.size(near) - 1, F.lit(1))
    return rows.withColumn("score", F.when(nearest == 0, F.lit(float(k))).otherwise(F.least(F.lit(float(k)), others / nearest)))


#: Rows of each table that first centres are chosen from.
SEED_ROWS = 500


def _uniform_copies(rows: DataFrame, vector: str, n: int, copies: int, seed: int) -> DataFrame:
    """(part, v): tables 1..copies of n rows each, uniform in the range of each column of the vectors."""
    ranges = rows.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.min("x").alias("a"), F.max("x").alias("z")).orderBy("i").collect()
    low, wide = (F.array(*(F.lit(float(x)) for x in xs)) for xs in ([r["a"] for r in ranges], [r["z"] - r["a"] for r in ranges]))
    made = rows.sparkSession.range(n * copies)
    at = lambda i: hash_order(hash_order(F.col("id"), seed) + i.cast("long") * 1000003) / float(MODULUS)
    v = F.zip_with(low, F.transform(wide, lambda w, i: w * at(i)), lambda a, x: a + x)
    return made.select((F.col("id") % copies + 1).cast("int").alias("part"), v.alias("v"))


def _first_centres(sample: dict[int, np.ndarray], ks: list[int], seed: int) -> dict[tuple[int, int], np.ndarray]:
    """For each table and k: centres drawn from its sample far from each other (k-means++), the best of four draws."""
    out = {}
    for part, x in sample.items():
        for k in ks:
            best = None
            for turn in range(4):
                rng = np.random.default_rng([seed, part, k, turn])
                centres = [x[rng.integers(len(x))]]
                for _ in range(k - 1):
                    d = ((x[:, None, :] - np.array(centres)[None]) ** 2).sum(2).min(1)
                    centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[0])
                centres = np.array(centres)
                for _ in range(8):
                    near = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
                    centres = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(k)])
                cost = ((x[:, None, :] - centres[None]) ** 2).sum(2).min(1).sum()
                if best is None or cost < best[0]:
                    best = (cost, centres)
            out[part, k] = best[1]
    return out


def clustering_costs(tables: DataFrame, ks: list[int], rounds: int = 10, seed: int = 1) -> dict[tuple[int, int], float]:
    """The k-means cost of every table (part, v) for every k, all found in the same passes over the rows.

    A pass assigns each row to the nearest centre of each k of its own table and adds up counts,
    sums and costs inside tasks; what meets is a row for each table, k and centre. First centres come
    from SEED_ROWS rows of each table.
    """
    ship(tables.sparkSession)
    sample: dict[int, list] = {}
    for r in bottom_k(tables.withColumn("row", F.xxhash64("v")), ["part"], "row", SEED_ROWS, seed).select("part", "v").collect():
        sample.setdefault(r["part"], []).append(r["v"])
    centres = _first_centres({p: np.array(sorted(x), float) for p, x in sample.items()}, ks, seed)
    costs: dict[tuple[int, int], float] = {}
    for turn in range(rounds + 1):

        def assign(frames: Iterable[pd.DataFrame], centres=centres) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for part, rows in frame.groupby("part")["v"]:
                    x = np.stack(rows.to_list())
                    squares = (x * x).sum(1)
                    for k in ks:
                        c = centres[part, k]
                        d = squares[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T
                        near = d.argmin(1)
                        least = np.maximum(d[np.arange(len(x)), near], 0)
                        for j in np.unique(near):
                            mine = near == j
                            out.append((part, k, int(j), int(mine.sum()), float(least[mine].sum()), x[mine].sum(0).tolist()))
                yield pd.DataFrame(out, columns=["part", "k", "centre", "n", "cost", "s"])

        sums = tables.select("part", "v").mapInPandas(assign, "part int, k int, centre int, n long, cost double, s array<double>")
        cells = sums.select("part", "k", "centre", "n", "cost", F.posexplode("s").alias("i", "x")).groupBy("part", "k", "centre", "i").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.sum("x").alias("x"))
        found = cells.groupBy("part", "k", "centre").agg(F.max("n").alias("n"), F.max("cost").alias("cost"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("s")).collect()
        costs, moved = {}, {key: c.copy() for key, c in centres.items()}
        for r in found:
            key = (r["part"], r["k"])
            costs[key] = costs.get(key, 0.0) + r["cost"]
            moved[key][r["centre"]] = np.array(r["s"]) / r["n"]
        if turn == rounds or all(np.allclose(moved[key], centres[key], rtol=0, atol=1e-9) for key in centres):
            break
        centres = moved
    return costs


def gap_statistic(rows: DataFrame, vector: str, most: int, copies: int = 10, seed: int = 1, rounds: int = 10) -> tuple[DataFrame, int]:
    """A table (k, cost, log_w, log_w_ref, gap, s, f) for k = 1..most, and the number of clusters.

    log_w is the logarithm of the cost over twice the dimensions, log_w_ref its mean over tables of
    uniform rows in the columns' ranges, s their deviation times sqrt(1 + 1 / copies). The number of
    clusters is the least k whose gap is not under the next one's less its s. f compares the cost
    with the last one's, weighed by the dimensions; low values speak for k.
    """
    data = cut(rows.select(F.lit(0).alias("part"), F.col(vector).cast("array<double>").alias("v")).where("v is not null"))
    n, size = data.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        raise ValueError("no vectors")
    ks = list(range(1, most + 1))
    costs = clustering_costs(cut(data.unionByName(_uniform_copies(data, "v", n, copies, seed))), ks, rounds, seed)
    log_w = {key: float(np.log(max(c, 1e-12) / (2 * size))) for key, c in costs.items()}
    out, share = [], 0.0
    for k in ks:
        known = np.array([log_w[b, k] for b in range(1, copies + 1)])
        share = (1 - 3 / (4 * size) if k == 2 else share + (1 - share) / 6) if k > 1 else 0.0
        before = costs.get((0, k - 1), 0.0)
        f = costs[0, k] / (share * before) if k > 1 and before and share else 1.0
        out.append((k, costs[0, k], log_w[0, k], float(known.mean()), float(known.mean() - log_w[0, k]), float(known.std() * np.sqrt(1 + 1 / copies)), float(f)))
    best = next((a[0] for a, b in zip(out, out[1:]) if a[4] >= b[4] - b[5]), most)
    return rows.sparkSession.createDataFrame(out, "k int, cost double, log_w double, log_w_ref double, gap double, s double, f double"), best


def mixture(rows: DataFrame, vector: str, k: int, seed: int = 1, rounds: int = 20):
    """(rows with cluster and probability, weights) of a Gaussian mixture."""
    data = rows.withColumn("__v", array_to_vector(vector))
    model = GaussianMixture(k=k, seed=seed, maxIter=rounds, featuresCol="__v", predictionCol="cluster", probabilityCol="__p").fit(data)
    out = model.transform(data).withColumn("probability", vector_to_array("__p")).drop("__v", "__p")
    return out, list(model.weights)


def lsh_neighbours(rows: DataFrame, queries: DataFrame, row_id: str, vector: str, radius: float, width: float = 0.5, tables: int = 8, seed: int = 1) -> DataFrame:
    """(query, row_id, d): rows within ``radius`` of each query that share a random-projection bucket with it."""
    model = BucketedRandomProjectionLSH(inputCol="__v", outputCol="__h", bucketLength=width, numHashTables=tables, seed=seed)
    a = rows.select(row_id, array_to_vector(vector).alias("__v"))
    b = queries.select(F.col(row_id).alias("query"), array_to_vector(vector).alias("__v"))
    pairs = model.fit(a).approxSimilarityJoin(b, a, radius, distCol="d")
    return pairs.select(F.col("datasetA.query").alias("query"), F.col(f"datasetB.{row_id}").alias(row_id), "d").where(F.col("query") != F.col(row_id))


def vote(neighbours: DataFrame, labels: DataFrame, row_id: str, theta: float = 0.6) -> DataFrame:
    """(query, a, b): labels by summed 1/d weights; b is the runner-up unless the best holds at least theta of the weight."""
    return elected(neighbours.join(labels, row_id).groupBy("query", "label").agg(F.sum(1 / F.greatest("d", F.lit(1e-9))).alias("w")), theta)


def lsh_vote(rows: DataFrame, queries: DataFrame, row_id: str, vector: str, label: str, radius: float, width: float = 0.5, tables: int = 8, seed: int = 1, theta: float = 0.6) -> DataFrame:
    """(query, a, b): the ``vote`` of the ``lsh_neighbours``, without a row for each of them.

    Wide buckets hold most of the rows, so blocks of queries meet blocks of rows, and only summed weights by query and label
    leave a task. Rows without a vector have no part.
    """
    model = BucketedRandomProjectionLSH(inputCol="__v", outputCol="__h", bucketLength=width, numHashTables=tables, seed=seed)
    a, b = (df.where(F.size(vector) > 0).select(F.col(row_id).alias("name"), F.col(vector).alias("v"), F.col(label).alias("label"), array_to_vector(vector).alias("__v")) for df in (rows, queries))
    fitted = model.fit(a)
    buckets = F.array(*(F.get(vector_to_array(F.get("__h", t)), 0) for t in range(tables))).alias("h")
    a, b = (fitted.transform(df).select("name", "v", "label", buckets) for df in (a, b))
    n, size = b.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = f"query {rows.schema[row_id].dataType.simpleString()}, label {rows.schema[label].dataType.simpleString()}, w double"
    parts = blocks.met(a, b, "name", max(1, -(-n * (64 + 8 * (tables + (size or 0))) // QUERY_BYTES)), blocks.weights(radius), schema)
    return elected(parts.groupBy("query", "label").agg(F.sum("w").alias("w")), theta)


def elected(weighed: DataFrame, theta: float) -> DataFrame:
    """(query, a, b) of summed weights (query, label, w), as ``vote`` says."""
    w = Window.partitionBy("query")
    ranked = weighed.withColumns({"share": F.col("w") / F.sum("w").over(w), "rank": F.row_number().over(w.orderBy(F.desc("w"), "label"))})
    out = ranked.where("rank <= 2").groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.struct("label", "share"))).alias("x"), F.max(F.when(F.col("rank") == 2, F.col("label"))).alias("y"))
    return out.select("query", F.col("x.label").alias("a"), F.when(F.col("x.share") >= theta, F.col("x.label")).otherwise(F.coalesce("y", "x.label")).alias("b"))


def sign_bits(vector: str, planes: int, size: int, seed: int = 1):
    """Bits of a random-projection hash: on which side of fixed random planes a vector lies, as one number."""
    drawn = np.random.default_rng(seed).normal(size=(planes, size))
    bits = [F.when(vec.dot(F.col(vector), F.array(*(F.lit(float(x)) for x in plane))) > 0, 1 << k).otherwise(0) for k, plane in enumerate(drawn)]
    return sum(bits[1:], bits[0])
