"""Distributions, intervals and convergence over events and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats as op
from .tables import events, frames, rounded, table


def posterior_local_global(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.local_global_pdf(events(spark, sf), F.col("event_id") % 10 == 0, "event_type"))


def incremental_posterior(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the first half of the events, then merged with the rest as a batch."""
    e = events(spark, sf)
    first = e.where("event_id % 2 = 0").groupBy("event_type").agg(F.count("*").alias("n"))
    return rounded(op.merge_posterior(first, e.where("event_id % 2 = 1"), "event_type"))


def bootstrap_std(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.bootstrap_std(events(spark, sf), "value", "event_type"))


def bootstrap_block(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.bootstrap_block(events(spark, sf), ["user_id"], "event_id", "value", 10), 9)


def bootstrap_iter(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("step", F.floor(F.col("event_id") / 500))
    return rounded(op.bootstrap_iter(rows, "step", "event_type"))


def convergence_series(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.convergence_series(events(spark, sf), ["user_id"], "event_id", "value").select("event_id", "k", "mean", "ci", "conv"), 9)


def well_tran_rollup(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    pairs = events(spark, sf).select("event_type", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("b")).where("b is not null")
    return rounded(op.well_tran(pairs, "event_type", "b"))


def pearson_skew(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.skew(events(spark, sf), "value", "user_id"))


def histogram20(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.histogram(events(spark, sf), "value", 4.0, 200.0, 20, "event_type"))


def vector_histogram(spark: SparkSession, sf: str) -> DataFrame:
    parts = frames(spark, sf).select(F.posexplode("x").alias("i", "v"))
    return rounded(op.histogram(parts, "v", -0.25, 0.25, 20, "i"))


def l2_normalised_matrix(spark: SparkSession, sf: str) -> DataFrame:
    cells = events(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    return rounded(op.l2_rows(cells, "user_id", "n").select("user_id", "event_type", "unit"))


def pdf_of_pdfs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.pdf_of_pdfs(events(spark, sf), "user_id", "event_type"))


def order_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.order_statistics(events(spark, sf), "value", 0.05, 0.95, "user_id"))


def feature_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Two levels: the interval of each element of the vectors of each label, then of the labels' means."""
    parts = frames(spark, sf).select("label", F.posexplode("x").alias("i", "v"))
    own = op.bootstrap_std(parts, "v", "label", "i")
    return rounded(op.bootstrap_std(own, "mean", "i").select("i", "mean", "ci", "sigma", "n"))


def cluster_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Variance of each label's vectors: the trace of their covariance."""
    parts = frames(spark, sf).select("label", F.posexplode("x").alias("i", "v"))
    return rounded(parts.groupBy("label", "i").agg(F.var_samp("v").alias("v")).groupBy("label").agg(F.sum("v").alias("variance")))


def cost_elasticity(spark: SparkSession, sf: str) -> DataFrame:
    """Convergence of each user's mean value at the thresholds of its running cost."""
    from ..operators.sequence import at_thresholds

    series = op.convergence_series(events(spark, sf), ["user_id"], "event_id", "value")
    return rounded(at_thresholds(series, ["user_id"], "event_id", "value", 2000.0).select("user_id", "bucket", "k", "conv"))


def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return rounded(o.groupBy("o_orderstatus").agg(F.max("o_orderdate").alias("last_end"), F.count("*").alias("n"), F.sum("o_totalprice").alias("cost")), 2)


def flag_census(spark: SparkSession, sf: str) -> DataFrame:
    """Alive, dead and zombie entries: balances over, at or under thresholds."""
    c = table(spark, sf, "customer")
    return c.groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") > 0).alias("alive"), F.count_if(F.col("c_acctbal") <= 0).alias("dead"), F.count_if(F.col("c_acctbal") < -500).alias("zombie"))


def resampled_shares(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.resampled_shares(events(spark, sf), "event_id", "event_type", 100))


_FEATURES = ["value", "hour", "k"]


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    """Events with three numbers each: value, hour of the day, and k of the properties."""
    return events(spark, sf).select("event_id", "value", F.hour("ts").cast("double").alias("hour"), F.get_json_object("props", "$.k").cast("double").alias("k"))


def bootstrap_replacement(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.bootstrap_replacement(_measured(spark, sf), "event_id", _FEATURES, samples=40))


def bootstrap_param(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.bootstrap_param(_measured(spark, sf), "event_id", _FEATURES, samples=20))


def bootstrap_mv(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.bootstrap_mv(_measured(spark, sf), "event_id", _FEATURES, samples=20)[0])


def bootstrap_mv_covariance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.bootstrap_mv(_measured(spark, sf), "event_id", _FEATURES, samples=20)[1])


QUERIES = {f.__name__: f for f in (posterior_local_global, incremental_posterior, bootstrap_std, bootstrap_block, bootstrap_iter, convergence_series, well_tran_rollup, pearson_skew, histogram20, vector_histogram, l2_normalised_matrix, pdf_of_pdfs, order_statistics, feature_bootstrap, cluster_variance, cost_elasticity, run_totals, flag_census, resampled_shares, bootstrap_replacement, bootstrap_param, bootstrap_mv, bootstrap_mv_covariance)}

_W = "(PARTITION BY user_id ORDER BY event_id)"
_CI = "round(avg({v}), 6) AS mean, round(1.645 * stddev_pop({v}) / sqrt(count({v})), 6) AS ci, round(stddev_pop({v}), 6) AS sigma"
_SERIES = """q AS (SELECT *, count(*) OVER w AS k, avg(value) OVER w AS mean, 1.645 * stddev_pop(value) OVER w / sqrt(count(*) OVER w) AS ci FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), c AS (SELECT *, least(CASE WHEN mean = 0 THEN 1 ELSE coalesce(ci / mean, 1) END, 1) AS conv FROM q)"""
_SHARES = "t AS (SELECT {k} AS step, count(*) AS total FROM events GROUP BY 1), l AS (SELECT DISTINCT event_type FROM events), n AS (SELECT {k} AS step, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT step, event_type, coalesce(n, 0) / total::DOUBLE AS share FROM t CROSS JOIN l LEFT JOIN n USING (step, event_type))"


def _hash(c: str) -> str:
    one = f"(((({c}) % 2147483648) * 1103515245 + 12345) % 2147483648)"
    return f"((xor({one}, {one} >> 15) * 1103515245 + 12345) % 2147483648)"


def _samples(n: int, size: str) -> str:
    """mu: means of all events; b: means of the samples, by feature."""
    names = ("value", "hour", "k")
    return f"""WITH v AS (SELECT event_id, value, hour(ts)::DOUBLE AS hour, CAST(props->>'k' AS DOUBLE) AS k FROM events), c AS (SELECT count(*) AS n FROM v), r AS (SELECT ({size})::DOUBLE / n AS rate FROM c),
    e AS (SELECT sum(exp(i * ln(rate) - rate - lgamma(i + 1))) OVER (ORDER BY i) AS edge FROM r, range(0, 90) t(i)),
    q AS (SELECT list(edge) AS edges FROM e WHERE edge < 1 - 1e-12),
    h AS (SELECT v.*, s, {_hash(_hash('event_id') + ' + s * 1000003')} / 2147483648.0::DOUBLE AS u FROM v, range(0, {n}) t(s)),
    d AS (SELECT h.*, len(list_filter(q.edges, lambda x: u >= x)) AS t FROM h, q),
    w AS (SELECT s, {', '.join(f'sum(t * {c}) / sum(t) AS {c}' for c in names)} FROM d GROUP BY s),
    b AS ({' UNION ALL '.join(f"SELECT s, '{c}' AS feature, {c} AS m FROM w" for c in names)}),
    mu AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, avg({c}) AS mean FROM v" for c in names)})"""


ORACLE_SQL = {
    "bootstrap_replacement": f"""{_samples(40, 'greatest(10000, least(round(n * 0.1), 25000))')}, l AS (SELECT feature, mean, list(m - mean ORDER BY m) AS d FROM b JOIN mu USING (feature) GROUP BY ALL),
        o AS (SELECT feature, mean, d[3] AS lo, d[39] AS hi FROM l) SELECT feature, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, round(abs((hi - lo) / mean), 6) AS err FROM o""",
    "bootstrap_param": f"{_samples(20, 'n')} SELECT feature, round(any_value(mean), 6) AS mean, round(1.645 * stddev_pop(m) / sqrt(20), 6) AS ci, round(stddev_pop(m), 6) AS sigma, round(stddev_pop(m) / sqrt(20), 6) AS err, round(abs(1.645 * stddev_pop(m) / sqrt(20) / any_value(mean)), 6) AS rel FROM b JOIN mu USING (feature) GROUP BY feature",
    "bootstrap_mv": f"{_samples(20, 'least(50000, n)')} SELECT feature, round(avg(m), 6) AS mean, round(1.645 * stddev_pop(m) / sqrt(20), 6) AS ci, round(stddev_pop(m), 6) AS sigma, round(stddev_pop(m) / sqrt(20), 6) AS err, round(abs(1.645 * stddev_pop(m) / sqrt(20) / avg(m)), 6) AS rel FROM b GROUP BY feature",
    "bootstrap_mv_covariance": f"{_samples(20, 'least(50000, n)')} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 6) AS c FROM w" for a, b in (("value", "value"), ("value", "hour"), ("value", "k"), ("hour", "hour"), ("hour", "k"), ("k", "k"))),
    "posterior_local_global": "SELECT event_type, count(*) FILTER (event_id % 10 = 0) AS n_local, count(*) AS n_all, round(count(*) FILTER (event_id % 10 = 0) / (sum(count(*) FILTER (event_id % 10 = 0)) OVER ())::DOUBLE, 6) AS p_local, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS p_all FROM events GROUP BY 1",
    "incremental_posterior": "SELECT event_type, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS p FROM events GROUP BY 1",
    "bootstrap_std": f"SELECT event_type, {_CI.format(v='value')}, round(stddev_pop(value) / sqrt(count(value)), 6) AS err, round(abs(1.645 * stddev_pop(value) / sqrt(count(value)) / avg(value)), 6) AS rel, count(value) AS n FROM events GROUP BY 1",
    "bootstrap_block": f"""WITH r AS (SELECT *, row_number() OVER {_W} - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS rows FROM events), b AS (SELECT user_id, CASE WHEN (rn // 10 + 1) * 10 < rows THEN rn // 10 END AS block, avg(value) AS m, sum(value) AS s, count(value) AS c FROM r GROUP BY ALL),
        g AS (SELECT user_id, sum(s) / sum(c) AS mean, count(block) AS blocks, stddev_pop(CASE WHEN block IS NOT NULL THEN m END) AS sigma FROM b GROUP BY 1)
        SELECT user_id, round(mean, 9) AS mean, blocks, CASE WHEN blocks < 2 THEN 1 ELSE round(sigma, 9) END AS sigma, CASE WHEN blocks < 2 THEN 1 ELSE round(sigma / sqrt(blocks), 9) END AS err, CASE WHEN blocks < 2 THEN 1 ELSE round(1.645 * sigma / sqrt(blocks), 9) END AS ci FROM g""",
    "bootstrap_iter": f"WITH {_SHARES.format(k='event_id // 500')} SELECT event_type, {_CI.format(v='share')}, round(stddev_pop(share) / sqrt(count(share)), 6) AS err, round(abs(1.645 * stddev_pop(share) / sqrt(count(share)) / avg(share)), 6) AS rel, count(share) AS n FROM s GROUP BY 1",
    "convergence_series": f"WITH {_SERIES} SELECT event_id, k, round(mean, 9) AS mean, round(ci, 9) AS ci, round(conv, 9) AS conv FROM c",
    "well_tran_rollup": f"WITH p AS (SELECT event_type AS a, lead(event_type) OVER {_W} AS b FROM events) SELECT CASE WHEN a = b THEN 'W' ELSE 'T' END || a AS kind, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS p FROM p WHERE b IS NOT NULL GROUP BY 1",
    "pearson_skew": "SELECT user_id, round((avg(value) - quantile_cont(value, 0.5)) / nullif(stddev_pop(value), 0), 6) AS skew, count(value) AS n FROM events GROUP BY 1",
    "histogram20": "WITH b AS (SELECT event_type, least(floor((value - 4) * 20 / 196), 19)::BIGINT AS bin FROM events WHERE value BETWEEN 4 AND 200) SELECT event_type, bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY event_type))::DOUBLE, 6) AS p FROM b GROUP BY event_type, bin",
    "vector_histogram": "WITH x AS (SELECT generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), b AS (SELECT i, least(floor((v + 0.25) * 20 / 0.5), 19)::BIGINT AS bin FROM x WHERE v BETWEEN -0.25 AND 0.25) SELECT i, bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY i))::DOUBLE, 6) AS p FROM b GROUP BY i, bin",
    "l2_normalised_matrix": "WITH n AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL) SELECT user_id, event_type, round(n / sqrt(sum(n * n) OVER (PARTITION BY user_id)), 6) AS unit FROM n",
    "pdf_of_pdfs": f"WITH {_SHARES.format(k='user_id')} SELECT event_type, round(avg(share), 6) AS mean, round(stddev_pop(share), 6) AS deviation, round(avg(share) / sum(avg(share)) OVER (), 6) AS p FROM s GROUP BY 1",
    "order_statistics": """WITH r AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
        SELECT user_id, round(avg(v), 6) AS mean, round(max(v) FILTER (rn = floor(n * 0.05::DOUBLE + 0.5)), 6) AS lo, round(max(v) FILTER (rn = least(floor(n * 0.95::DOUBLE), n - 1)), 6) AS hi, count(*) AS n FROM r GROUP BY 1""",
    "feature_bootstrap": f"WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL) SELECT i, {_CI.format(v='m')}, count(*) AS n FROM m GROUP BY 1",
    "cluster_variance": "WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT label, i, var_samp(v) AS v FROM x GROUP BY ALL) SELECT label, round(sum(v), 6) AS variance FROM m GROUP BY 1",
    "cost_elasticity": f"""WITH {_SERIES}, t AS (SELECT *, floor(sum(TRY_CAST(value AS DECIMAL(28, 6))) OVER {_W}::DOUBLE / 2000)::BIGINT AS bucket FROM c), l AS (SELECT *, coalesce(lag(bucket) OVER {_W}, 0) AS before FROM t)
        SELECT user_id, bucket, k, round(conv, 6) AS conv FROM l WHERE bucket > before""",
    "run_totals": "SELECT o_orderstatus, max(o_orderdate) AS last_end, count(*) AS n, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY 1",
    "flag_census": "SELECT c_mktsegment, count(*) FILTER (c_acctbal > 0) AS alive, count(*) FILTER (c_acctbal <= 0) AS dead, count(*) FILTER (c_acctbal < -500) AS zombie FROM customer GROUP BY 1",
}
