"""Windows, segments, transitions and interval joins over events: users are trajectories, event types are states."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..lineage import shared_root
from ..operators import sequence as op
from ..operators import stats
from ..sources import trajectories
from .tables import events, frames, rounded, table

KEYS, ORDER = ["user_id"], "event_id"
_SEQ = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events"


def _chunked(spark: SparkSession, sf: str, size: int = 10) -> DataFrame:
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return events(spark, sf).withColumn("chunk", F.floor(rn / size))


def noise_filter_centered(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.noise_filter(events(spark, sf), KEYS, ORDER, "value", 3).select("event_id", "smooth"))


def rms_delta(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.centred_delta(events(spark, sf), KEYS, ORDER, "value").select("event_id", "delta"))


def transition_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return op.transitions(events(spark, sf), KEYS, ORDER, "event_type").select("user_id", "event_id", "a", "b")


def transition_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.transition_matrix(op.transitions(events(spark, sf), KEYS, ORDER, "event_type")))


def transition_matrix_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    pairs = op.transitions(events(spark, sf), KEYS, ORDER, "event_type").withColumn("step", F.floor(F.col("event_id") / 1000))
    return rounded(op.cumulative_transition_matrix(pairs, "step"))


def dwell_segments(spark: SparkSession, sf: str) -> DataFrame:
    return op.dwell_segments(events(spark, sf), KEYS, ORDER, "event_type")


def segment_links(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of ten events, as windows between boundaries and with links to their neighbours."""
    bounds = _chunked(spark, sf).groupBy("user_id", "chunk").agg(F.min("event_id").alias("at"))
    windows = op.boundary_windows(bounds, KEYS, "at")
    return rounded(op.linked(windows, KEYS, "start", "idx").select("user_id", "idx", "start", "end", "prev_id", "next_id"))


def segment_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.segment_stats(_chunked(spark, sf), ["user_id", "chunk"], "value"))


def segment_label10(spark: SparkSession, sf: str) -> DataFrame:
    return op.segment_label10(_chunked(spark, sf), ["user_id", "chunk"], ORDER, "event_type", 0.5)


def segment_label25(spark: SparkSession, sf: str) -> DataFrame:
    return op.segment_label25(_chunked(spark, sf), ["user_id", "chunk"], ORDER, "event_type", 0.4)


def chunk_activity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.chunk_activity(events(spark, sf), [], ORDER, "event_type", "view", 500))


def gap_compressed_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return op.compress_gaps(events(spark, sf), KEYS, "ts", 1800).groupBy("user_id").agg(F.max("busy").alias("busy"), F.sum("gap").alias("elapsed"), F.count_if(F.col("gap") > 1800).alias("idle_gaps"))


def progress_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.at_thresholds(events(spark, sf), KEYS, ORDER, "value", 1000.0).select("user_id", "event_id", "total", "bucket"), 4)


def settled_states(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("state", F.when(F.col("event_type").isin("view", "click"), "busy").otherwise("rare"))
    return op.settled(rows, KEYS, ORDER, "state").groupBy("user_id", "state").agg(F.count("*").alias("n"))


def burn_in_cap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.bootstrap_std(op.burn_in(events(spark, sf), KEYS, ORDER, 5, 30), "value", "user_id").select("user_id", "mean", "ci", "n"))


def fluctuation_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.fluctuation(events(spark, sf), KEYS, ORDER, "value", 3).select("event_id", "to_first", "spread", "lag1", "lag2", "lag3"))


def element_fluctuation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.rmsf(frames(spark, sf), "x"))


def theta_crossover(spark: SparkSession, sf: str) -> DataFrame:
    d = op.centred_delta(events(spark, sf), KEYS, ORDER, "value").withColumn("d", F.col("delta") - 100)
    return rounded(op.crossover(d, KEYS, "d"))


def range_join_job_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Events inside jobs: an order is a job over the half-open range of 7 events that starts at its key times 3."""
    jobs = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") * 3).alias("start"), (F.col("o_orderkey") * 3 + 7).alias("end"))
    inside = op.interval_join(events(spark, sf).select("event_id", "event_type", "value"), "event_id", jobs, "start", "end", 7)
    return rounded(inside.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


def srcbin_contingency(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "orders").select("o_orderstatus", (F.col("o_orderkey") * 3).alias("start"), (F.col("o_orderkey") * 3 + 7).alias("end"))
    inside = op.interval_join(events(spark, sf).select("event_id", "event_type"), "event_id", jobs, "start", "end", 7)
    return stats.contingency(inside, "o_orderstatus", "event_type", ["click", "error", "purchase", "signup", "view"])


def asof_forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    """The last purchase's value at or before each error of the same user."""
    e = events(spark, sf)
    out = op.forward_fill(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), KEYS, ORDER, "value")
    return rounded(out.select("user_id", "event_id", "value"))


def contact_states(spark: SparkSession, sf: str) -> DataFrame:
    """At every event: how many users' contacts are on, formed by a signup and broken by an error."""
    e = events(spark, sf)
    told = e.where("event_type in ('signup', 'error')").select("user_id", F.col("event_id").alias("step"), F.when(F.col("event_type") == "signup", "+++").otherwise("---").alias("kind"))
    return rounded(op.contact_counts(told, KEYS, "step", "kind", e.select(F.col("event_id").alias("step"))))


def windowed_variance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.windowed_variance(frames(spark, sf), "vec_id", "x", 100, 50))


def windowed_covariance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.windowed_covariance(frames(spark, sf), "vec_id", "x", 100, 50))


def strided_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth event of each user, from the third on."""
    return op.strided(events(spark, sf), KEYS, ORDER, 10, 2).select("user_id", "event_id")


_NAMES, _RESIDUE = ("N", "CA", "C", "O", "CB"), ("ALA", "GLY", "SER", "VAL", "HOH")


def trajectory_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors as frames of 21 atoms, written as PDB text; the backbone of every third frame, read back."""
    at = f"{shared_root(spark)}/strandline/pdb-{uuid.uuid4().hex}"
    trajectories.write_pdb(_atoms(spark, sf), at)
    return trajectories.read_pdb(spark, at, first=1, stride=3, select="backbone").select("frame", "serial", "name", "residue", *(F.round(c, 3).alias(c) for c in "xyz"), F.round("b", 2).alias("b"))


def _atoms(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("x")
    atoms = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda a: F.struct((a + 1).alias("serial"), *(F.get(v, a * 3 + k).alias(c) for k, c in enumerate("xyz"))))
    rows = frames(spark, sf).select((F.col("vec_id") + 1).alias("frame"), F.get(v, 63).alias("b"), F.explode(atoms).alias("a")).select("frame", "b", "a.*")
    turn = (F.col("serial") - 1).cast("int")
    return rows.withColumns({"name": F.element_at(F.array(*map(F.lit, _NAMES)), turn % 5 + 1), "resid": F.floor(turn / 5).cast("int"), "residue": F.element_at(F.array(*map(F.lit, _RESIDUE)), F.floor(turn / 5).cast("int") + 1)})


def side_chain_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Mean distance over all frames of each pair of side-chain atoms."""
    atoms = _atoms(spark, sf)
    place = atoms.select("frame", "serial", "x", "y", "z")
    a, b = (place.withColumnsRenamed({"serial": k, "x": f"{k}x", "y": f"{k}y", "z": f"{k}z"}) for k in "ab")
    both = a.join(F.broadcast(trajectories.side_chain_pairs(atoms)), "a").join(b, ["frame", "b"])
    d = F.sqrt(sum((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz"))
    return rounded(both.groupBy("a", "b").agg(F.avg(d).alias("d"), F.count("*").alias("n")))


def pairwise_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of each user's values by the distances to all of a segment."""
    rows = events(spark, sf).select("user_id", "event_id", F.array("value").alias("x"))
    return op.pairwise_segments(rows, KEYS, ORDER, "x", 300.0)


def job_sequence_numbers(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("job-"), (F.col("o_orderkey") % 7).cast("string"), F.lit("."), (F.col("o_orderkey") % 100).cast("string")).alias("name"))
    return names.select("o_orderkey", text.job_number(F.col("name")).alias("seq"))


def running_mean_segments(spark: SparkSession, sf: str) -> DataFrame:
    return op.running_mean_segments(events(spark, sf), KEYS, ORDER, "value", 4, 40.0).groupBy("user_id", "seg").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def drift_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("user_id", "event_id", F.array("value").alias("x"))
    return op.drift_segments(rows, KEYS, ORDER, "x", 150.0, 2)


QUERIES = {f.__name__: f for f in (noise_filter_centered, rms_delta, transition_pairs, transition_matrix, transition_matrix_cumulative, dwell_segments, segment_links, segment_stats, segment_label10, segment_label25, chunk_activity, gap_compressed_timeline, progress_thresholds, settled_states, burn_in_cap, fluctuation_features, element_fluctuation, theta_crossover, range_join_job_obs, srcbin_contingency, asof_forward_fill, contact_states, windowed_variance, windowed_covariance, strided_events, trajectory_scan, side_chain_distances, pairwise_segments, job_sequence_numbers, running_mean_segments, drift_segments)}

_W = "(PARTITION BY user_id ORDER BY event_id)"
_PAIRS = f"t AS (SELECT user_id, event_id, event_type AS a, lead(event_type) OVER {_W} AS b FROM events), p AS (SELECT * FROM t WHERE a <> b)"
_CHUNKS = f"s AS ({_SEQ}), ch AS (SELECT *, rn // 10 AS chunk FROM s)"
_RANKS = f"""{_CHUNKS}, k AS (SELECT user_id, chunk, event_type AS s, count(*) AS c FROM ch GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, chunk ORDER BY c DESC, s DESC) AS r FROM k),
    g AS (SELECT user_id, chunk, count(*) AS n, arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last FROM ch GROUP BY ALL),
    tops AS (SELECT user_id, chunk, max(s) FILTER (r = 1) AS a, max(c) FILTER (r = 1) AS ca, max(s) FILTER (r = 2) AS b FROM rk GROUP BY ALL),
    z AS (SELECT * FROM g JOIN tops USING (user_id, chunk))"""
_JOBS = "j AS (SELECT o_orderkey, o_orderstatus, o_orderkey * 3 AS s, o_orderkey * 3 + 7 AS e FROM orders), i AS (SELECT * FROM events JOIN j ON event_id >= s AND event_id < e)"
_WINDOWS = "w AS (SELECT x.*, k AS win FROM x, (SELECT unnest(range(0, 100000)) AS k) WHERE k * 50 <= vec_id AND vec_id < k * 50 + 100 AND k * 50 + 100 <= (SELECT max(vec_id) + 1 FROM embeddings))"
_LONG = "x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
ORACLE_SQL = {
    "noise_filter_centered": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM events",
    "rms_delta": f"SELECT event_id, round(coalesce(abs(lead(value) OVER {_W} - lag(value) OVER {_W}), 0), 6) AS delta FROM events",
    "transition_pairs": f"WITH {_PAIRS} SELECT user_id, event_id, a, b FROM p",
    "transition_matrix": f"WITH {_PAIRS}, c AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL) SELECT a, b, n, round(n / (sum(n) OVER (PARTITION BY a))::DOUBLE, 6) AS p FROM c",
    "transition_matrix_cumulative": f"""WITH {_PAIRS}, q AS (SELECT event_id // 1000 AS step, a, b FROM p), sp AS (SELECT * FROM (SELECT DISTINCT step FROM q), (SELECT DISTINCT a, b FROM q)),
        c AS (SELECT step, a, b, count(*) AS n FROM q GROUP BY ALL), u AS (SELECT step, a, b, sum(coalesce(n, 0)) OVER (PARTITION BY a, b ORDER BY step)::BIGINT AS total FROM sp LEFT JOIN c USING (step, a, b))
        SELECT step, a, b, total, round(total / (sum(total) OVER (PARTITION BY step, a))::DOUBLE, 6) AS p FROM u WHERE total > 0""",
    "dwell_segments": f"""WITH m AS (SELECT *, CASE WHEN event_type <> lag(event_type) OVER {_W} THEN 1 ELSE 0 END AS ch FROM events), s AS (SELECT *, (sum(ch) OVER {_W})::BIGINT AS seg FROM m),
        r AS (SELECT user_id, seg, any_value(event_type) AS state, min(event_id) AS start, max(event_id) AS "end", count(*) AS length FROM s GROUP BY ALL)
        SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY seg) AS prev, lead(state) OVER (PARTITION BY user_id ORDER BY seg) AS next FROM r""",
    "segment_links": f"""WITH {_CHUNKS}, b AS (SELECT user_id, chunk, min(event_id) AS pos FROM ch GROUP BY ALL),
        w AS (SELECT user_id, lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS start, pos AS "end", row_number() OVER (PARTITION BY user_id ORDER BY pos) - 2 AS idx FROM b), v AS (SELECT * FROM w WHERE start IS NOT NULL)
        SELECT user_id, idx, start, "end", lag(idx) OVER (PARTITION BY user_id ORDER BY start) AS prev_id, lead(idx) OVER (PARTITION BY user_id ORDER BY start) AS next_id FROM v""",
    "segment_stats": f"WITH {_CHUNKS} SELECT user_id, chunk, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(quantile_cont(value, 0.5), 6) AS median, count(value) AS n FROM ch GROUP BY ALL",
    "segment_label10": f"WITH {_RANKS} SELECT user_id, chunk, CASE WHEN ca::DOUBLE / n < 0.5 OR first <> last THEN 'T' ELSE 'W' END || a AS label FROM z",
    "segment_label25": f"""WITH {_RANKS}, y AS (SELECT *, ca::DOUBLE / n < 0.4 AS low, first <> last AND first IN (a, coalesce(b, a)) AND last IN (a, coalesce(b, a)) AS ends FROM z)
        SELECT user_id, chunk, CASE WHEN NOT low AND ends THEN first ELSE a END AS state_a, CASE WHEN low THEN coalesce(b, a) WHEN ends THEN last ELSE a END AS state_b FROM y""",
    "chunk_activity": "SELECT event_id // 500 AS chunk, round(1.0 - avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END), 6) AS activity, count(*) AS n FROM events GROUP BY 1",
    "gap_compressed_timeline": """WITH g AS (SELECT user_id, coalesce(epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts), 0) AS gap FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events))
        SELECT user_id, sum(CASE WHEN gap > 1800 THEN 0 ELSE gap END)::BIGINT AS busy, sum(gap)::BIGINT AS elapsed, count(*) FILTER (gap > 1800) AS idle_gaps FROM g GROUP BY 1""",
    "progress_thresholds": f"""WITH t AS (SELECT *, sum(TRY_CAST(value AS DECIMAL(28, 6))) OVER {_W}::DOUBLE AS total FROM events), b AS (SELECT *, floor(total / 1000)::BIGINT AS bucket FROM t), l AS (SELECT *, coalesce(lag(bucket) OVER {_W}, 0) AS before FROM b)
        SELECT user_id, event_id, round(total, 4) AS total, bucket FROM l WHERE bucket > before""",
    "settled_states": f"""WITH s AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'busy' ELSE 'rare' END AS state FROM events),
        k AS (SELECT *, lag(state, 1) OVER {_W} = state AND lag(state, 2) OVER {_W} = state AND lead(state, 1) OVER {_W} = state AND lead(state, 2) OVER {_W} = state AS ok FROM s)
        SELECT user_id, state, count(*) AS n FROM k WHERE ok GROUP BY ALL""",
    "burn_in_cap": f"WITH s AS ({_SEQ}) SELECT user_id, round(avg(value), 6) AS mean, round(1.645 * stddev_pop(value) / sqrt(count(value)), 6) AS ci, count(value) AS n FROM s WHERE rn >= 5 AND rn < 35 GROUP BY 1",
    "fluctuation_features": f"""SELECT event_id, round(value - first_value(value) OVER {_W}, 6) AS to_first, round(stddev_pop(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS spread,
        round(value - lag(value, 1) OVER {_W}, 6) AS lag1, round(value - lag(value, 2) OVER {_W}, 6) AS lag2, round(value - lag(value, 3) OVER {_W}, 6) AS lag3 FROM events""",
    "element_fluctuation": f"WITH {_LONG} SELECT i, round(stddev_pop(v), 6) AS rmsf FROM x GROUP BY i",
    "theta_crossover": f"""WITH d AS (SELECT user_id, coalesce(abs(lead(value) OVER {_W} - lag(value) OVER {_W}), 0) - 100 AS d FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d) AS rank FROM d),
        s AS (SELECT *, (lead(d) OVER (PARTITION BY user_id ORDER BY rank) - lag(d) OVER (PARTITION BY user_id ORDER BY rank)) / 2 AS slope FROM r),
        o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(slope, -1) DESC, rank) AS k FROM s)
        SELECT user_id, max(rank) FILTER (k = 1) AS steepest, round(max(slope), 6) AS slope, count(*) FILTER (d < 0) AS crossing, count(*) AS n FROM o GROUP BY 1""",
    "range_join_job_obs": f"WITH {_JOBS} SELECT o_orderkey, count(*) AS n, round(avg(value), 6) AS mean FROM i GROUP BY 1",
    "srcbin_contingency": f"WITH {_JOBS} SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS c_{t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM i GROUP BY 1",
    "asof_forward_fill": "SELECT e.user_id, e.event_id, round(p.value, 6) AS value FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.event_id >= p.event_id",
    "contact_states": """WITH t AS (SELECT user_id, event_id AS step, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS o FROM events WHERE event_type IN ('signup', 'error')),
        d AS (SELECT step, o - coalesce(lag(o) OVER (PARTITION BY user_id ORDER BY step), 0) AS d FROM t)
        SELECT event_id AS step, coalesce(sum(d) OVER (ORDER BY event_id), 0)::BIGINT AS contacts, (SELECT count(DISTINCT user_id) FROM t) AS pairs FROM events LEFT JOIN d ON d.step = event_id""",
    "windowed_variance": f'WITH {_LONG}, {_WINDOWS} SELECT win AS "window", i, round(var_samp(v), 6) AS variance FROM w GROUP BY ALL',
    "windowed_covariance": f'WITH {_LONG}, {_WINDOWS} SELECT a.win AS "window", a.i, b.i AS j, round(covar_samp(a.v, b.v), 6) AS covariance FROM w a JOIN w b ON a.win = b.win AND a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL',
    "strided_events": f"WITH s AS ({_SEQ}) SELECT user_id, event_id FROM s WHERE rn >= 2 AND (rn - 2) % 10 = 0",
    "side_chain_distances": f"""WITH {_LONG}, a AS (SELECT vec_id, i // 3 + 1 AS serial, i % 3 AS axis, v FROM x WHERE i < 63 AND i // 3 + 1 IN (2, 7, 15, 20)),
        d AS (SELECT p.serial AS a, q.serial AS b, p.vec_id, sqrt(sum((p.v - q.v) * (p.v - q.v))) AS d FROM a p JOIN a q ON p.vec_id = q.vec_id AND p.axis = q.axis AND p.serial < q.serial GROUP BY ALL)
        SELECT a, b, round(avg(d), 6) AS d, count(*) AS n FROM d GROUP BY a, b""",
    "trajectory_scan": f"""WITH {_LONG}, a AS (SELECT vec_id + 1 AS frame, i // 3 + 1 AS serial, i % 3 AS axis, v FROM x WHERE i < 63), m AS (SELECT vec_id + 1 AS frame, v AS b FROM x WHERE i = 63),
        p AS (SELECT frame, serial, {list(_NAMES)}[(serial - 1) % 5 + 1] AS name, {list(_RESIDUE)}[(serial - 1) // 5 + 1] AS residue, max(v) FILTER (axis = 0) AS x, max(v) FILTER (axis = 1) AS y, max(v) FILTER (axis = 2) AS z FROM a GROUP BY ALL)
        SELECT frame, serial, name, residue, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, round(b, 2) AS b FROM p JOIN m USING (frame) WHERE (frame - 1) % 3 = 0 AND name <> 'CB'""",
    "job_sequence_numbers": "SELECT o_orderkey, 100 * (o_orderkey % 7) + o_orderkey % 100 AS seq FROM orders",
    "running_mean_segments": f"""WITH r AS (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m FROM events),
        j AS (SELECT *, CASE WHEN abs(m - lag(m) OVER {_W}) > 40 THEN 1 ELSE 0 END AS j FROM r), s AS (SELECT *, (sum(j) OVER {_W})::BIGINT AS seg FROM j)
        SELECT user_id, seg, count(*) AS n, min(event_id) AS first FROM s GROUP BY ALL""",
    "drift_segments": f"""WITH RECURSIVE s AS ({_SEQ}), w AS (SELECT user_id, rn, event_id, value AS ref, 0::BIGINT AS seg FROM s WHERE rn = 0
        UNION ALL SELECT s.user_id, s.rn, s.event_id, CASE WHEN abs(s.value - w.ref) <= 150 THEN w.ref ELSE s.value END, CASE WHEN abs(s.value - w.ref) <= 150 THEN w.seg ELSE w.seg + 1 END FROM w JOIN s ON s.user_id = w.user_id AND s.rn = w.rn + 1)
        SELECT user_id, seg, min(event_id) AS start, max(event_id) AS "end", count(*) AS length FROM w GROUP BY user_id, seg HAVING count(*) > 2""",
}
