"""Samples that can be repeated: rows are ordered by arithmetic hashes of their ids, never by ``rand``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

#: Fixed values of the multiplicative hash.
MULTIPLIER, STEP, MODULUS = 1103515245, 12345, 1 << 31


def hash_order(row_id: Column, seed: int = 0) -> Column:
    """A number in 0..2**31 - 1 that orders ids without regard to their size; any SQL engine can compute it."""
    first = F.pmod(F.pmod(row_id.cast("long") + seed, F.lit(MODULUS)) * MULTIPLIER + STEP, F.lit(MODULUS))
    return F.pmod(first.bitwiseXOR(F.shiftright(first, 15)) * MULTIPLIER + STEP, F.lit(MODULUS))


def bottom_k(rows: DataFrame, keys: list[str], row_id: str, k: int, seed: int = 0) -> DataFrame:
    """A uniform sample of k rows of each key: the least hashes. Samples of parts merge into the sample of the whole."""
    placed = rows.withColumn("h", hash_order(F.col(row_id), seed))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h", row_id))
    return placed.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def reservoir_state(sample: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: size of the reservoir, rows seen, spill (seen but not held) and percent held."""
    held = sample.groupBy(*keys).agg(F.count("*").alias("size"))
    seen = rows.groupBy(*keys).agg(F.count("*").alias("seen"))
    return seen.join(held, keys, "left").withColumn("size", F.coalesce("size", F.lit(0))).withColumns({"spill": F.col("seen") - F.col("size"), "percent": F.col("size") / F.col("seen")})


def uniform(rows: DataFrame, row_id: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement."""
    return rows.withColumn("h", hash_order(F.col(row_id), seed)).orderBy("h", row_id).limit(n).drop("h")


def select_value(rows: DataFrame, column: str, value, row_id: str, most: int | None = None, seed: int = 0) -> DataFrame:
    """Rows with a value; if there are more than ``most``, a sample of that many."""
    found = rows.where(F.col(column) == value)
    return uniform(found, row_id, most, seed) if most else found


def umbrella_pdf(counts: DataFrame, count: str = "n", slack: float = 0.01) -> DataFrame:
    """Adds p, higher for emptier bins: max(0, M - count) with M = max + slack * sum, 0 for empty bins, normalised."""
    w = Window.partitionBy()
    top = F.max(count).over(w) + slack * F.sum(count).over(w)
    weight = F.when(F.col(count) > 0, F.greatest(top - F.col(count), F.lit(0.0))).otherwise(0.0)
    return counts.withColumn("weight", weight).withColumn("p", F.coalesce(F.try_divide(F.col("weight"), F.sum("weight").over(w)), F.lit(0.0)))


def mean_umbrella_pdf(counts: DataFrame, count: str = "n") -> DataFrame:
    """Like ``umbrella_pdf`` with M = 1 + mean."""
    w = Window.partitionBy()
    weight = F.greatest(1 + F.avg(count).over(w) - F.col(count), F.lit(0.0))
    return counts.withColumn("weight", weight).withColumn("p", F.coalesce(F.try_divide(F.col("weight"), F.sum("weight").over(w)), F.lit(0.0)))


def normalised(rows: DataFrame, weight: str, *by: str) -> DataFrame:
    """Adds p: the weight over the sum of weights (by keys)."""
    return rows.withColumn("p", F.coalesce(F.try_divide(F.col(weight), F.sum(weight).over(Window.partitionBy(*by))), F.lit(0.0)))


def weighted_draws(bins: DataFrame, name: str, p: str, n: int, seed: int = 0) -> DataFrame:
    """n draws (draw, name) from a pdf over bins by inverting its cumulative sums. Bins are few: a pdf's support."""
    w = Window.partitionBy().orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    cumulated = bins.where(F.col(p) > 0).select(name, p, F.sum(p).over(w).alias("hi")).withColumn("lo", F.col("hi") - F.col(p))
    draws = bins.sparkSession.range(n).select(F.col("id").alias("draw"), (hash_order(F.col("id"), seed) / float(MODULUS)).alias("u"))
    last = cumulated.agg(F.max("hi").alias("top"))
    draws = draws.crossJoin(F.broadcast(last)).withColumn("u", F.col("u") * F.col("top"))
    return draws.join(F.broadcast(cumulated), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", name)


def draw_members(draws: DataFrame, members: DataFrame, name: str, rank: str) -> DataFrame:
    """Each cluster's j-th draw takes its j-th ranked member, so none repeats; draws beyond a cluster's members are left out."""
    turn = F.row_number().over(Window.partitionBy(name).orderBy("draw"))
    return draws.withColumn(rank, turn).join(members, [name, rank]).select("draw", name, *[c for c in members.columns if c != name])


def capped(rows: DataFrame, cluster: str, row_id: str, cap: int, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows of each cluster, with their ids to refer back."""
    return bottom_k(rows, [cluster], row_id, cap, seed).drop("h")


def round_robin(rows: DataFrame, bin_: str, row_id: str, n: int, seed: int = 0) -> DataFrame:
    """n rows taken from the bins in turns."""
    turn = F.row_number().over(Window.partitionBy(bin_).orderBy(hash_order(F.col(row_id), seed), row_id))
    return rows.withColumn("turn", turn).orderBy("turn", bin_).limit(n)


def correlation_features(transactions: DataFrame, n_rows: int, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Features that are neither almost never nor almost always on with the others: (item, score = mean share of common rows)."""
    distinct = transactions.select("tid", "item").distinct()
    a, b = distinct.alias("a"), distinct.alias("b")
    common = a.join(b, F.expr("a.tid = b.tid and a.item <> b.item")).groupBy(F.col("a.item").alias("item"), F.col("b.item").alias("other")).agg(F.count("*").alias("n"))
    shares = common.groupBy("item").agg(F.avg(F.col("n") / F.lit(n_rows)).alias("score"))
    return shares.where((F.col("score") >= low) & (F.col("score") <= high))


def knapsack_scores(rows: DataFrame, row_id: str, vector: str, target: list[float]) -> DataFrame:
    """Greedy fit of each row to a target vector: the sum over features of the value's share of the target, 1 at most each."""
    goals = F.array(*(F.lit(float(t)) for t in target))
    fit = F.aggregate(F.zip_with(vector, goals, lambda x, t: F.least(F.coalesce(F.try_divide(x, t), F.lit(0.0)), F.lit(1.0))), F.lit(0.0), lambda s, x: s + x)
    return rows.select(row_id, fit.alias("score"))


def running_total(rows: DataFrame, by: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to each one in an order that leaves no ties.

    Rows are dealt to ranges of the order and summed inside each; a range starts from the totals of
    those before it, of which there is one row each. No task sees more than its range.
    """
    placed = cut(rows.withColumn("__value", value).repartitionByRange(*by).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__range").agg(F.sum("__value").alias("s")).select("__range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__start"))
    own = F.sum("__value").over(Window.partitionBy("__range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + own).drop("__range", "__value", "__start")


def knapsack_fill(rows: DataFrame, row_id: str, score: str, size: str, capacity: float) -> DataFrame:
    """The best scored rows whose running size fits the capacity."""
    return running_total(rows, [F.desc(score), F.asc(row_id)], F.col(size), "filled").where(F.col("filled") <= capacity)


def knapsack_oscillate(rows: DataFrame, chosen: DataFrame, row_id: str, vector: str, capacity: list[float], rounds: int = 100) -> tuple[DataFrame, float, float]:
    """(chosen ids, what was unfilled or over before, and after): exchanges of chosen rows for others that fit the capacity better.

    What counts is the sum over features of the distance between the chosen rows' total and the
    capacity. Each round tries every other row in the place of every chosen one, in one pass over
    the rows against the chosen, and makes the best exchange (the lower ids among equals) while it
    improves. ``chosen`` (row_id) are the slots of the knapsack and must fit a broadcast, 10,000 at most.
    """
    held = rows.join(chosen.select(row_id), row_id, "left_semi").select(row_id, vector).limit(10_001).collect()
    if len(held) > 10_000:
        raise ValueError("more than 10,000 slots")
    spark, schema = rows.sparkSession, rows.select(row_id, F.col(vector).cast("array<double>").alias(vector)).schema
    slots = {r[row_id]: [float(x) for x in r[vector]] for r in held}
    goal = [float(c) for c in capacity]
    rest = lambda: [g - sum(v[k] for v in slots.values()) for k, g in enumerate(goal)]
    first = best = sum(map(abs, rest()))
    for _ in range(rounds if slots else 0):
        left = F.array(*map(F.lit, rest()))
        out = F.broadcast(spark.createDataFrame(list(slots.items()), schema).select(F.col(row_id).alias("__out"), F.zip_with(left, vector, lambda x, y: x + y).alias("__free")))
        free = rows.join(spark.createDataFrame([(k,) for k in slots], f"{row_id} {schema[row_id].dataType.simpleString()}"), row_id, "left_anti")
        miss = F.aggregate(F.zip_with("__free", F.col(vector).cast("array<double>"), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
        found = free.crossJoin(out).select(miss.alias("miss"), "__out", F.col(row_id).alias("__in"), F.col(vector).cast("array<double>").alias("v")).agg(F.min_by(F.struct("__out", "__in", "v", "miss"), F.struct("miss", "__out", "__in")).alias("b")).first()["b"]
        if found is None or not found["miss"] < best - 1e-9 * max(1.0, best):
            break
        best = found["miss"]
        del slots[found["__out"]]
        slots[found["__in"]] = list(found["v"])
    return spark.createDataFrame([(k,) for k in slots], f"{row_id} {schema[row_id].dataType.simpleString()}"), first, best


def explorer_draws(members: DataFrame, weights: DataFrame, cluster: str, rank: str, n: int, seed: int = 0) -> DataFrame:
    """The first ``n`` draws of clusters by their ``weights`` (cluster, w), each taking the cluster's next ranked member until it has none left.

    Draws of a cluster are a Poisson process of its weight's rate, so its j-th draw comes at a sum
    of j exponential waits; the earliest n draws of all clusters are what drawing one after the
    other and drawing again for an exhausted cluster gives. ``members`` has an integer ``cluster``
    and ``rank`` from 1. Adds at, by which draws are ordered.
    """
    u = (hash_order(hash_order(F.col(cluster), seed) + F.col(rank) * 1000003) + 0.5) / float(MODULUS)
    own = members.where(F.col(rank) <= n).join(F.broadcast(weights.where("w > 0").select(cluster, "w")), cluster)
    at = F.sum(-F.log(u) / F.col("w")).over(Window.partitionBy(cluster).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("at", at).drop("w").orderBy("at", cluster).limit(n)


def fairness_weight(preference: Column, fatigue: Column, alpha: float = 0.5, beta: float = 0.5) -> Column:
    return alpha * preference + beta * (1 - fatigue)


def aged_merge(new: DataFrame, old: DataFrame, priority: str, ts: str, now: float, most: int = 100) -> DataFrame:
    """The ``most`` best of two queues; an old entry's priority ages by its time stamp over now."""
    aged = old.withColumn(priority, F.col(priority) * F.col(ts) / F.lit(now))
    return new.unionByName(aged).orderBy(F.desc(priority), F.desc(ts)).limit(most)


def top_unexecuted(rows: DataFrame, executed: DataFrame, name: str, score: str, k: int) -> DataFrame:
    return rows.join(executed.select(name), name, "left_anti").orderBy(F.desc(score), name).limit(k)
