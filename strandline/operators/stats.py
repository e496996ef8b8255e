"""Distributions, confidence intervals and convergence.

Confidence intervals are Z * sigma / sqrt(n) with Z = 1.645 and the population deviation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import MODULUS, hash_order

Z = 1.645


def interval(value: str) -> dict[str, Column]:
    """mean, ci, sigma, err, and rel (|ci / mean|, null for a mean of 0) of a column, to be aggregated."""
    mean, sigma, n = F.avg(value), F.stddev_pop(value), F.count(value)
    err = sigma / F.sqrt(n)
    return {"mean": mean, "ci": F.lit(Z) * err, "sigma": sigma, "err": err, "rel": F.abs(F.try_divide(F.lit(Z) * err, mean))}


def bootstrap_std(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """The interval of the values of each key."""
    return rows.groupBy(*keys).agg(*(c.alias(n) for n, c in interval(value).items()), F.count(value).alias("n"))


def bootstrap_block(rows: DataFrame, keys: list[str], order: str, value: str, size: int) -> DataFrame:
    """Interval of the means of successive blocks of ``size`` rows; mean is that of all rows.

    Blocks end strictly before the last row, so a block that fits exactly is left out, as is a
    shorter rest. With fewer than two blocks, ci, sigma and err are 1.
    """
    w = Window.partitionBy(*keys)
    placed = rows.withColumn("rn", F.row_number().over(w.orderBy(order)) - 1).withColumn("rows", F.count("*").over(w))
    block = F.floor(F.col("rn") / size)
    inside = (block + 1) * size < F.col("rows")
    sums = placed.groupBy(*keys, F.when(inside, block).alias("block")).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("c"))
    out = sums.groupBy(*keys).agg(
        F.sum("s").alias("s"), F.sum("c").alias("c"), F.count("block").alias("blocks"), F.stddev_pop(F.when(F.col("block").isNotNull(), F.col("m"))).alias("sigma")
    )
    few = F.col("blocks") < 2
    err = F.col("sigma") / F.sqrt("blocks")
    return out.select(*keys, (F.col("s") / F.col("c")).alias("mean"), "blocks", F.when(few, 1.0).otherwise(F.col("sigma")).alias("sigma"), F.when(few, 1.0).otherwise(err).alias("err"), F.when(few, 1.0).otherwise(F.lit(Z) * err).alias("ci"))


def label_shares(rows: DataFrame, step: str, label: str) -> DataFrame:
    """Share of every label in every step, 0 where a step lacks it."""
    counts = rows.groupBy(step, label).agg(F.count("*").alias("n"))
    steps = counts.groupBy(step).agg(F.sum("n").alias("total"))
    spine = steps.crossJoin(F.broadcast(counts.select(label).distinct()))
    return spine.join(counts, [step, label], "left").select(step, label, (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def bootstrap_iter(rows: DataFrame, step: str, label: str) -> DataFrame:
    """Interval of each label's share over successive steps (blocks)."""
    return bootstrap_std(label_shares(rows, step, label), "share", label)


def convergence(mean: Column, ci: Column) -> Column:
    """ci / mean, at most 1; 1 where it is undefined."""
    return F.least(F.coalesce(F.try_divide(ci, mean), F.lit(1.0)), F.lit(1.0))


def convergence_series(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Interval over the first k rows of each key, for every k: adds k, mean, ci and conv."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"k": F.count("*").over(w), "mean": F.avg(value).over(w), "sigma": F.stddev_pop(value).over(w)})
    out = out.withColumn("ci", F.lit(Z) * F.col("sigma") / F.sqrt("k"))
    return out.withColumn("conv", convergence(F.col("mean"), F.col("ci")))


def well_tran(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows by kind: a well ``W<a>`` where both states are equal, a transition ``T<a>`` else."""
    kind = F.concat(F.when(F.col(a) == F.col(b), "W").otherwise("T"), F.col(a).cast("string")).alias("kind")
    return rows.groupBy(kind).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))


def local_global_pdf(rows: DataFrame, local: Column, label: str) -> DataFrame:
    """Share of each label among the local rows and among all."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n_all"), F.count_if(local).alias("n_local"))
    w = Window.partitionBy()
    return counts.select(label, "n_local", "n_all", F.coalesce(F.try_divide(F.col("n_local"), F.sum("n_local").over(w)), F.lit(0.0)).alias("p_local"), (F.col("n_all") / F.sum("n_all").over(w)).alias("p_all"))


def merge_posterior(counts: DataFrame, batch: DataFrame, label: str) -> DataFrame:
    """Counts (label, n) after another batch, and shares of the new total."""
    merged = counts.select(label, "n").unionByName(batch.groupBy(label).agg(F.count("*").alias("n")))
    return merged.groupBy(label).agg(F.sum("n").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))


def skew(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(mean - median) / population deviation; null for constants."""
    return rows.groupBy(*keys).agg(F.try_divide(F.avg(value) - F.percentile(value, F.lit(0.5)), F.stddev_pop(value)).alias("skew"), F.count(value).alias("n"))


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """Zero-based bin of a histogram whose last bin is closed; null outside."""
    return F.when((x >= low) & (x <= high), F.least(F.floor((x - low) * bins / (high - low)), F.lit(bins - 1)).cast("int"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, *keys: str) -> DataFrame:
    """Count n and share p of the in-range values by bin."""
    counted = rows.withColumn("bin", bin_of(F.col(value), low, high, bins)).where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    return counted.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def l2_rows(cells: DataFrame, row: str, value: str) -> DataFrame:
    """Adds unit: the value over the Euclidean norm of its row, 0 in a zero row."""
    length = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(row)))
    return cells.withColumn("unit", F.coalesce(F.try_divide(F.col(value), length), F.lit(0.0)))


def pdf_of_pdfs(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Mean and population deviation over keys of each label's share, and the mean normalised to a sum of 1."""
    shares = label_shares(rows, key, label)
    out = shares.groupBy(label).agg(F.avg("share").alias("mean"), F.stddev_pop("share").alias("deviation"))
    return out.withColumn("p", F.col("mean") / F.sum("mean").over(Window.partitionBy()))


def contingency(rows: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """Counts of a (rows) by b (columns c_<value>), 0 where absent."""
    return rows.groupBy(a).agg(*(F.count_if(F.col(b) == v).alias(f"c_{v}") for v in values))


def resampled_shares(rows: DataFrame, row_id: str, label: str, samples: int = 200, low: float = 0.05, high: float = 0.95, seed: int = 0) -> DataFrame:
    """Bootstrap of label shares: p over all rows, lo and hi (percentiles over samples) and rel = (hi - lo) / p.

    Every row is drawn a Poisson(1) number of times in each sample, which needs no row count and
    no shuffle of rows: draws come from a hash of the row's id and the sample, and only the counts
    by sample and label are shuffled.
    """
    u = F.pmod(F.xxhash64(row_id, "sample", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    edges, at, term = [], 0.0, 2.718281828459045**-1
    for k in range(12):
        at += term
        edges.append(at)
        term /= k + 1
    times = sum((F.when(u >= e, 1).otherwise(0) for e in edges), F.lit(0))
    drawn = rows.select(row_id, label, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    counts = drawn.groupBy("sample", label).agg(F.sum(times).alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("sample")))
    spread = shares.groupBy(label).agg(F.sort_array(F.collect_list("share")).alias("s"))
    spread = spread.select(label, F.get("s", F.floor(F.size("s") * low).cast("int")).alias("lo"), F.get("s", F.least(F.floor(F.size("s") * high), F.size("s") - 1).cast("int")).alias("hi"))
    whole = rows.groupBy(label).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return whole.join(spread, label).withColumn("rel", (F.col("hi") - F.col("lo")) / F.col("p"))


def poisson_edges(rate: float) -> list[float]:
    """Cumulated probabilities of 0, 1, 2, ... draws at a mean of ``rate``, until the rest is under 2**-32."""
    edges, term, at, k = [], math.exp(-rate), 0.0, 0
    while 1 - at >= 2.0**-32 and k < 10 * rate + 60:
        at += term
        edges.append(at)
        k += 1
        term *= rate / k
    return edges


def draws(row_id: Column, sample: Column, rate: float, seed: int = 0) -> Column:
    """How often a row is drawn for a sample: a Poisson number from the arithmetic hash of the row's and the sample's numbers."""
    u = hash_order(hash_order(row_id, seed) + sample * 1000003) / float(MODULUS)
    return sum((F.when(u >= e, 1).otherwise(0) for e in poisson_edges(rate)), F.lit(0))


def resampled_means(rows: DataFrame, row_id: str, values: list[str], samples: int, size: int, n: int, seed: int = 0) -> DataFrame:
    """(sample, and the mean of each of ``values``) over samples with replacement of about ``size`` of the ``n`` rows.

    No sample is ever made: each task adds up, for each sample, its rows times the number of times
    that they are drawn, and only these sums are shuffled, a row for each sample. A sample that
    draws no row has null means.
    """
    wide = rows.select(F.col(row_id).cast("long").alias("id"), *(F.col(v).cast("double").alias(v) for v in values), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    drawn = wide.withColumn("times", draws(F.col("id"), F.col("sample"), size / n, seed))
    sums = drawn.groupBy("sample").agg(*(F.try_divide(F.sum(F.col("times") * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.col("times")))).alias(v) for v in values))
    return sums.select("sample", *values)


def _by_feature(wide: DataFrame, values: list[str]) -> DataFrame:
    return wide.select(F.explode(F.array(*(F.struct(F.lit(v).alias("feature"), F.col(v).alias("m")) for v in values))).alias("x")).select("x.feature", "x.m")


def bootstrap_replacement(rows: DataFrame, row_id: str, values: list[str], share: float = 0.1, samples: int = 100, interval_size: float = 0.9, bounds: tuple[int, int] = (10_000, 25_000), seed: int = 0) -> DataFrame:
    """feature, mean, lo, hi and err of the means of samples with replacement.

    A sample has ``share`` of the rows, but neither less nor more than ``bounds``; lo and hi are
    percentiles of the samples' deviations from the mean, err is their distance over the mean.
    """
    whole = rows.agg(F.count("*").alias("n"), *(F.avg(v).alias(v) for v in values)).first()
    n, size = max(1, whole["n"]), max(bounds[0], min(round(whole["n"] * share), bounds[1]))
    low = (1 - interval_size) / 2
    means = _by_feature(resampled_means(rows, row_id, values, samples, size, n, seed), values)
    mean = _by_feature(rows.agg(*(F.avg(v).alias(v) for v in values)), values).withColumnRenamed("m", "mean")
    ranked = means.join(F.broadcast(mean), "feature").groupBy("feature", "mean").agg(F.sort_array(F.collect_list(F.col("m") - F.col("mean"))).alias("d"))
    last = F.size("d") - 1
    at = lambda x: F.get("d", F.least(x.cast("int"), last))
    out = ranked.select("feature", "mean", at(F.round(F.size("d") * F.lit(low))).alias("lo"), at(F.floor(F.size("d") * F.lit(1 - low))).alias("hi"))
    return out.withColumn("err", F.abs(F.try_divide(F.col("hi") - F.col("lo"), F.col("mean"))))


def bootstrap_param(rows: DataFrame, row_id: str, values: list[str], samples: int = 10, seed: int = 0) -> DataFrame:
    """feature, and the normal interval of the means of samples as large as the table, around the mean of all rows."""
    n = max(1, rows.count())
    own = bootstrap_std(_by_feature(resampled_means(rows, row_id, values, samples, n, n, seed), values), "m", "feature")
    mean = _by_feature(rows.agg(*(F.avg(v).alias(v) for v in values)), values).withColumnRenamed("m", "all")
    return own.join(F.broadcast(mean), "feature").select("feature", F.col("all").alias("mean"), "ci", "sigma", "err", F.abs(F.try_divide(F.col("ci"), F.col("all"))).alias("rel"))


def bootstrap_mv(rows: DataFrame, row_id: str, values: list[str], samples: int = 10, most: int = 50_000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two tables: feature with the normal interval of the sample means around their own mean, and (a, b, c), the covariance of the features' sample means.

    All features of a sample are drawn together, so the means vary as the features do. A sample has
    ``most`` rows, or as many as the table.
    """
    n = max(1, rows.count())
    means = resampled_means(rows, row_id, values, samples, min(most, n), n, seed)
    own = bootstrap_std(_by_feature(means, values), "m", "feature").drop("n")
    pairs = [(a, b) for k, a in enumerate(values) for b in values[k:]]
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("c")) for k, (a, b) in enumerate(pairs)))
    cov = means.agg(*(F.covar_samp(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs))).select(F.explode(cells).alias("x")).select("x.a", "x.b", "x.c")
    return own, cov


def order_statistics(rows: DataFrame, value: str, low: float, high: float, *keys: str) -> DataFrame:
    """The values at ranks round(n * low) and floor(n * high) of each key's sorted values, and their mean."""
    placed = rows.select(*keys, F.col(value).alias("v"), (F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1).alias("rn"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    lo, hi = F.col("rn") == F.floor(F.col("n") * low + 0.5), F.col("rn") == F.least(F.floor(F.col("n") * high), F.col("n") - 1)
    return placed.groupBy(*keys).agg(F.avg("v").alias("mean"), F.max(F.when(lo, F.col("v"))).alias("lo"), F.max(F.when(hi, F.col("v"))).alias("hi"), F.count("*").alias("n"))
