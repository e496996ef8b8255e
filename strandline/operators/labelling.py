"""Labels of frames and segments by their nearest centroids, and what is counted over labels.

Centroids are a table (state, c) with one row per state. There are few of them by nature; they
are gathered into a single array row, whose number of rows is checked, so that labelling a frame
is a projection: no row is multiplied and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..lineage import cut

#: States that one centroid array may hold.
MAX_STATES = 10_000


def centroids(frames: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label: (state, c, n). Sums are combined before the shuffle, by label and dimension."""
    parts = frames.where(F.col(label).isNotNull()).select(F.col(label).alias("state"), F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy("state", "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("x").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"])
    return means.groupBy("state").agg(ordered.alias("c"), F.max("n").alias("n"))


def merge_centroids(batches: DataFrame) -> DataFrame:
    """Combine centroids (state, c, n) of several batches into weighted means."""
    parts = batches.select("state", "n", F.posexplode("c").alias("i", "x"))
    sums = parts.groupBy("state", "i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"])
    return sums.groupBy("state").agg(ordered.alias("c"), F.max("n").alias("n"))


def with_distances(frames: DataFrame, cents: DataFrame, vector: str, weight: str | None = None) -> DataFrame:
    """Adds near: array of (d, state) for every centroid, nearest first, lower state first among equals."""
    held = F.struct("state", "c", (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    one = cents.agg(F.array_sort(F.collect_list(held)).alias("cents"))
    one = one.where(F.when(F.size("cents") <= MAX_STATES, True).otherwise(F.raise_error(F.lit(f"more than {MAX_STATES} centroids")).cast("boolean")))
    near = vec.once(vec.doubles(vector), lambda v: F.array_sort(F.transform("cents", lambda c: F.struct((c["w"] * vec.distance(v, c["c"])).alias("d"), c["state"].alias("state")))))
    return frames.crossJoin(F.broadcast(one)).withColumn("near", near).drop("cents")


def label_pair(near: Column, theta: float) -> tuple[Column, Column]:
    """(A, B): the nearest state, and the second if its distance is less than theta more, else the nearest again."""
    first, second = F.get(near, 0), F.get(near, 1)
    return first["state"], F.when(second["d"] - first["d"] < theta, second["state"]).otherwise(first["state"])


def posterior(rows: DataFrame, *keys: str) -> DataFrame:
    """Count n and share p of each combination of keys."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))


def confusion(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Count and share of the grand total of each (actual, predicted)."""
    return posterior(pairs.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()), actual, predicted)


def confusion_with_prior(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Like ``confusion``, on top of one observation of each state as itself."""
    known = pairs.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).select(actual, predicted)
    states = known.select(F.col(actual).alias("s")).union(known.select(predicted)).distinct()
    return posterior(known.union(states.select("s", "s")), actual, predicted)


def accuracy(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per actual state: rows, hits and hit rate."""
    hit = (F.col(actual) == F.col(predicted)).cast("long")
    return pairs.groupBy(actual).agg(F.count("*").alias("n"), F.sum(hit).alias("hits"), F.avg(hit).alias("rate"))


def _hot(distances: Column, states: int) -> Column:
    """10 at the nearest state, else 0; nothing is sought again for each state."""
    return vec.once(F.array_position(distances, F.array_min(distances)) - 1, lambda least: F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda k: F.when(k == least, F.lit(10.0)).otherwise(0.0)))


def _preferences(distances: Column, states: int, steep: float) -> Column:
    return F.array(*(vec.logistic(F.get(distances, a) - F.get(distances, b), 10.0, steep) for a in range(states) for b in range(a + 1, states)))


def landscape(distances: Column, states: int = 5, near: float = 10.0) -> Column:
    """Feature landscape of an array of state distances: one-hot of the nearest (0 or 10), proximities, and pairwise preferences.

    For 5 states these are 5 + 5 + 10 values: 10 at the nearest state; max(10 - d, 0); and
    10 / (1 + exp(-3 (d_a - d_b))) for a < b.
    """
    return vec.once(distances, lambda ds: F.concat(_hot(ds, states), F.transform(F.slice(ds, 1, states), lambda d: F.greatest(F.lit(near) - d, F.lit(0.0))), _preferences(ds, states, 3.0)))


def landscape_frames(distances: Column, states: int = 5, near: float = 10.0, far: float = 20.0) -> Column:
    """The landscape of a single frame: one-hot of the nearest (0 or 10), proximities that fall from 10 at ``near`` to 0 at ``far``, and pairwise preferences that favour the nearer state."""
    close = lambda d: 10.0 * F.greatest(F.lit(far) - F.greatest(d, F.lit(near)), F.lit(0.0)) / (far - near)
    return vec.once(distances, lambda ds: F.concat(_hot(ds, states), F.transform(F.slice(ds, 1, states), close), _preferences(ds, states, -3.0)))


def landscape_states(pairwise: Column, states: int = 5) -> Column:
    """For each state, whether it wins all its pairs: a pair's value under 5 favours its first state, over 5 its second."""
    index, k = {}, 0
    for a in range(states):
        for b in range(a + 1, states):
            index[a, b] = k
            k += 1

    def wins(values: Column) -> Column:
        found = []
        for s in range(states):
            tests = [(F.get(values, index[s, b]) < 5) for b in range(s + 1, states)] + [(F.get(values, index[a, s]) > 5) for a in range(s)]
            test = tests[0]
            for t in tests[1:]:
                test = test & t
            found.append(test)
        return F.array(*found)

    return vec.once(pairwise, wins)


def mean_profile(rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    """Mean, population deviation and number of each element (i) of a vector, by keys."""
    parts = rows.select(*keys, F.posexplode(vector).alias("i", "x"))
    return parts.groupBy(*keys, "i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"), F.count("x").alias("n"))


def adaptive_centroids(frames: DataFrame, vector: str, start: DataFrame, rounds: int = 10, tolerance: float = 1e-6) -> DataFrame:
    """Reassign frames to the nearest centroid and average again, until no centroid moves or ``rounds`` are over.

    Each round is one aggregation; the driver sees only the largest movement.
    """
    now = start.select("state", "c")
    for _ in range(rounds):
        nearest = with_distances(frames, now, vector).withColumn("state", F.get("near", 0)["state"])
        following = cut(centroids(nearest, "state", vector).select("state", "c"))
        moved = following.alias("a").join(now.alias("b"), "state").agg(F.max(vec.distance(F.col("a.c"), F.col("b.c")))).first()[0]
        now = following
        if moved is None or moved <= tolerance:
            break
    return now
