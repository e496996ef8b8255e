"""Labels, posteriors, confusion, profiles and centroids over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import labelling as op
from ..operators import learning
from .tables import CENTRES, LONG, frames, rounded, table

THETA = 0.05


def _near(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    return op.with_distances(f, op.centroids(f, "label", "x"), "x")


def label_top2_posterior(spark: SparkSession, sf: str) -> DataFrame:
    a, b = op.label_pair(F.col("near"), THETA)
    return rounded(op.posterior(_near(spark, sf).select(a.alias("state_a"), b.alias("state_b")), "state_a", "state_b"))


def label_confusion(spark: SparkSession, sf: str) -> DataFrame:
    near = _near(spark, sf).select("label", F.get("near", 0)["state"].alias("found"))
    return rounded(op.confusion(near, "label", "found"))


def label_confusion_prior(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    return rounded(op.confusion_with_prior(labels, "quality", "toxic"))


def label_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    near = _near(spark, sf).select("label", F.get("near", 0)["state"].alias("found"))
    return rounded(op.accuracy(near, "label", "found"))


def weighted_centroid_distance(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    cents = op.centroids(f, "label", "x").withColumn("w", 0.9 + F.col("state") * 0.01)
    near = op.with_distances(f, cents, "x", "w")
    return rounded(near.select("vec_id", F.get("near", 0)["state"].alias("state"), F.get("near", 0)["d"].alias("d")))


def label_centroids(spark: SparkSession, sf: str) -> DataFrame:
    cents = op.centroids(frames(spark, sf), "label", "x")
    return rounded(cents.select("state", F.posexplode("c").alias("i", "x"), "n"))


def merged_centroids(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    halves = [op.centroids(f.where(F.col("vec_id") % 2 == k), "label", "x") for k in (0, 1)]
    return rounded(op.merge_centroids(halves[0].unionByName(halves[1])).select("state", F.posexplode("c").alias("i", "x"), "n"))


def feature_landscape_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean landscape over frames of their distances (times 10) to the first five centroids."""
    d = F.transform(F.slice(F.array_sort(F.transform("near", lambda e: F.struct(e["state"].alias("s"), (e["d"] * 10).alias("d")))), 1, 5), lambda e: e["d"])
    return rounded(op.mean_profile(_near(spark, sf).select(op.landscape(d).alias("f")), "f").select("i", "mean", "deviation", "n"))


def feature_landscape_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Mean frame landscape of the distances (times 10) to the first five centroids."""
    d = F.transform(F.slice(F.array_sort(F.transform("near", lambda e: F.struct(e["state"].alias("s"), (e["d"] * 10).alias("d")))), 1, 5), lambda e: e["d"])
    return rounded(op.mean_profile(_near(spark, sf).select(op.landscape_frames(d).alias("f")), "f").select("i", "mean", "deviation", "n"))


def classify_score(spark: SparkSession, sf: str) -> DataFrame:
    """How clearly each vector belongs to its nearest centroid: the mean of the other distances over the least."""
    return rounded(learning.classify_scores(_near(spark, sf), "near", 10).select("vec_id", "score"))


def adaptive_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """The labels' centroids after two rounds of reassigning all vectors to the nearest."""
    f = frames(spark, sf)
    found = op.adaptive_centroids(f, "x", op.centroids(f, "label", "x"), rounds=2)
    return rounded(found.select(F.col("state").cast("long").alias("state"), F.posexplode("c").alias("i", "x")), 5)


def desired_landscape(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of each label's mean profile from ten minus the overall mean."""
    f = frames(spark, sf)
    whole = op.mean_profile(f, "x").select("i", (10 - F.col("mean")).alias("goal"))
    own = op.mean_profile(f, "x", "label").join(whole, "i")
    return rounded(own.groupBy("label").agg(F.sqrt(F.sum((F.col("mean") - F.col("goal")) * (F.col("mean") - F.col("goal")))).alias("d")))


def rmsd_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Four distances of each frame from frame 0, with points of two elements."""
    f = frames(spark, sf)
    first = f.where("vec_id = 0").select(F.col("x").alias("r"))
    out = f.crossJoin(F.broadcast(first))
    x, r = F.col("x"), F.col("r")
    return rounded(out.select("vec_id", vec.rmsd(x, r).alias("rmsd"), vec.distance(x, r).alias("dist"), vec.mean_root_distance(x, r, 2).alias("mean_root"), vec.scaled_distance_sum(x, r, 2).alias("scaled")))


def feature_classes(spark: SparkSession, sf: str) -> DataFrame:
    """How often each of five states wins all its pairs in a frame's landscape."""
    d = F.transform(F.slice(F.array_sort(F.transform("near", lambda e: F.struct(e["state"].alias("s"), (e["d"] * 10).alias("d")))), 1, 5), lambda e: e["d"])
    won = _near(spark, sf).select(F.posexplode(op.landscape_states(F.slice(op.landscape(d), 11, 10))).alias("state", "wins"))
    return rounded(won.groupBy("state").agg(F.count_if("wins").alias("n")))


def contact_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Mean smooth contact value of the distances between points of four elements, by label."""
    f = frames(spark, sf).select("label", F.explode(vec.pair_distances(F.col("x"), 4)).alias("d"))
    return rounded(f.groupBy("label").agg(F.avg(vec.contact(F.col("d"), 0.75)).alias("contact"), F.count("*").alias("n")))


QUERIES = {f.__name__: f for f in (label_top2_posterior, label_confusion, label_confusion_prior, label_accuracy, weighted_centroid_distance, label_centroids, merged_centroids, feature_landscape_mean, feature_landscape_frames, classify_score, adaptive_centroids, desired_landscape, rmsd_variants, feature_classes, contact_distance)}

_NEAREST = CENTRES + ", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, state) AS k FROM d)"
_FIVE = CENTRES + ", e AS (SELECT vec_id, list(d * 10 ORDER BY state) AS d FROM d WHERE state < 5 GROUP BY 1)"
_PAIRS = "[" + ", ".join(f"10 / (1 + exp(-3 * (d[{a + 1}] - d[{b + 1}])))" for a in range(5) for b in range(a + 1, 5)) + "]"
_LAND = f"""list_concat(list_concat(list_transform([1, 2, 3, 4, 5], lambda k: CASE WHEN k = list_position(d, list_min(d)) THEN 10.0 ELSE 0.0 END::DOUBLE),
    list_transform(d, lambda q: greatest(10 - q, 0))), {_PAIRS})"""
_FRAME = f"""list_concat(list_concat(list_transform([1, 2, 3, 4, 5], lambda k: CASE WHEN k = list_position(d, list_min(d)) THEN 10.0 ELSE 0.0 END::DOUBLE),
    list_transform(d, lambda q: 10.0 * greatest(20 - greatest(q, 10), 0) / 10)), {_PAIRS.replace("exp(-3", "exp(3")})"""


def _moved(rounds: int) -> str:
    """c<k>: centroids after k rounds of reassigning the vectors of x."""
    out = [f"{LONG}, c0 AS (SELECT label AS state, i, avg(v) AS v FROM x GROUP BY ALL)"]
    for k in range(rounds):
        out.append(f"d{k} AS (SELECT x.vec_id, c.state, sqrt(sum((x.v - c.v) * (x.v - c.v))) AS d FROM x JOIN c{k} c USING (i) GROUP BY x.vec_id, c.state), b{k} AS (SELECT vec_id, arg_min(state, (d, state)) AS state FROM d{k} GROUP BY 1)")
        out.append(f"c{k + 1} AS (SELECT b.state, i, avg(v) AS v FROM x JOIN b{k} b USING (vec_id) GROUP BY b.state, i)")
    return ", ".join(out)


_INDEX = {(a, b): k for k, (a, b) in enumerate((a, b) for a in range(5) for b in range(a + 1, 5))}
_WINS = [" AND ".join([f"p[{_INDEX[s, b] + 1}] < 5" for b in range(s + 1, 5)] + [f"p[{_INDEX[a, s] + 1}] > 5" for a in range(s)]) for s in range(5)]
ORACLE_SQL = {
    "label_top2_posterior": f"""WITH {_NEAREST},
        t AS (SELECT vec_id, max(state) FILTER (k = 1) AS a, max(state) FILTER (k = 2) AS s2, max(d) FILTER (k = 1) AS d1, max(d) FILTER (k = 2) AS d2 FROM r WHERE k <= 2 GROUP BY 1),
        l AS (SELECT a AS state_a, CASE WHEN d2 - d1 < {THETA} THEN s2 ELSE a END AS state_b FROM t)
        SELECT state_a::BIGINT AS state_a, state_b::BIGINT AS state_b, count(*) AS n, round(count(*)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE, 6) AS p FROM l GROUP BY ALL""",
    "label_confusion": f"""WITH {_NEAREST}, l AS (SELECT label, state AS found FROM r WHERE k = 1)
        SELECT label::BIGINT AS label, found::BIGINT AS found, count(*) AS n, round(count(*)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE, 6) AS p FROM l GROUP BY ALL""",
    "label_confusion_prior": """WITH k AS (SELECT quality, toxic FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
        s AS (SELECT quality AS s FROM k UNION SELECT toxic FROM k), u AS (SELECT * FROM k UNION ALL SELECT s, s FROM s)
        SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, count(*) AS n, round(count(*)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE, 6) AS p FROM u GROUP BY ALL""",
    "label_accuracy": f"""WITH {_NEAREST}, l AS (SELECT label, state AS found FROM r WHERE k = 1)
        SELECT label::BIGINT AS label, count(*) AS n, count(*) FILTER (label = found) AS hits, round(avg((label = found)::INT), 6) AS rate FROM l GROUP BY label""",
    "weighted_centroid_distance": f"""WITH {CENTRES}, w AS (SELECT vec_id, state, d * (0.9 + state * 0.01)::DOUBLE AS d FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, state) AS k FROM w)
        SELECT vec_id, state::BIGINT AS state, round(d, 6) AS d FROM r WHERE k = 1""",
    "label_centroids": f"WITH {LONG} SELECT label::BIGINT AS state, i::BIGINT AS i, round(avg(v), 6) AS x, count(*) AS n FROM x GROUP BY label, i",
    "merged_centroids": f"WITH {LONG} SELECT label::BIGINT AS state, i::BIGINT AS i, round(avg(v), 6) AS x, count(*) AS n FROM x GROUP BY label, i",
    "feature_landscape_mean": f"""WITH {_FIVE}, f AS (SELECT {_LAND} AS f FROM e), u AS (SELECT generate_subscripts(f, 1) - 1 AS i, unnest(f) AS v FROM f)
        SELECT i::BIGINT AS i, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, count(*) AS n FROM u GROUP BY i""",
    "feature_landscape_frames": f"""WITH {_FIVE}, f AS (SELECT {_FRAME} AS f FROM e), u AS (SELECT generate_subscripts(f, 1) - 1 AS i, unnest(f) AS v FROM f)
        SELECT i::BIGINT AS i, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, count(*) AS n FROM u GROUP BY i""",
    "classify_score": f"WITH {CENTRES} SELECT vec_id, round(least((sum(d) - min(d)) / (count(*) - 1) / min(d), 10), 6) AS score FROM d GROUP BY vec_id",
    "adaptive_centroids": f"WITH {_moved(2)} SELECT state::BIGINT AS state, i::BIGINT AS i, round(v, 5) AS x FROM c2",
    "desired_landscape": f"""WITH {LONG}, g AS (SELECT i, 10 - avg(v) AS goal FROM x GROUP BY i), m AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL)
        SELECT label::BIGINT AS label, round(sqrt(sum((m - goal) * (m - goal))), 6) AS d FROM m JOIN g USING (i) GROUP BY label""",
    "rmsd_variants": f"""WITH {LONG}, p AS (SELECT a.vec_id, a.i // 2 AS pt, sum((a.v - b.v) * (a.v - b.v)) AS q FROM x a JOIN x b ON a.i = b.i AND b.vec_id = 0 GROUP BY ALL)
        SELECT vec_id, round(sqrt(sum(q) / 64), 6) AS rmsd, round(sqrt(sum(q)), 6) AS dist, round(sqrt(sum(sqrt(q)) / 32), 6) AS mean_root, round(sum(sqrt(q)) / sqrt(32), 6) AS scaled FROM p GROUP BY vec_id""",
    "feature_classes": f"""WITH {_FIVE}, f AS (SELECT {_PAIRS} AS p FROM e), u AS ({' UNION ALL '.join(f'SELECT {s} AS state, ({w}) AS wins FROM f' for s, w in enumerate(_WINS))})
        SELECT state::BIGINT AS state, count(*) FILTER (wins) AS n FROM u GROUP BY state""",
    "contact_distance": f"""WITH {LONG}, p AS (SELECT a.vec_id, any_value(a.label) AS label, a.i // 4 AS pa, b.i // 4 AS pb, sqrt(sum((a.v - b.v) * (a.v - b.v))) / 0.75 AS r
        FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i % 4 = b.i % 4 AND a.i // 4 < b.i // 4 GROUP BY a.vec_id, pa, pb)
        SELECT label::BIGINT AS label, round(avg((1 - r * r) / (1 - r * r * r)), 6) AS contact, count(*) AS n FROM p GROUP BY label""",
}
