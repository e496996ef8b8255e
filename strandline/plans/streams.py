"""Streams over the events, read back as batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import shared_root
from ..streaming import streams as st
from .lattices import _h
from .tables import table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/events.parquet"
    return st.observations(spark, path + "*", spark.read.parquet(path).schema)


def stream_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return st.run_to_end(st.label_counts(_events(spark, sf), "event_type"))


def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return st.run_to_end(st.tumbling(_events(spark, sf), "ts", "1 day", "1 hour", "event_type")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    out = st.run_to_end(st.sliding(_events(spark, sf), "ts", "2 days", "1 day", "1 hour", "value"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.round("mean", 6).alias("mean"), "n")


def stream_session(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of the users, with a gap of six hours."""
    out = st.run_to_end(st.sessions(_events(spark, sf), "ts", "6 hours", "1 hour", "user_id"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def stream_incremental_posterior(spark: SparkSession, sf: str) -> DataFrame:
    return st.incremental_posterior(spark, _events(spark, sf), "event_type").withColumn("p", F.round("p", 6))


def stream_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Transitions of each user, found by state kept between batches and counted."""
    rows = st.run_to_end(st.keyed_transitions(_events(spark, sf).select("user_id", "ts", "event_type"), "user_id", "ts", "event_type"), "append")
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"))


def stream_gated(spark: SparkSession, sf: str) -> DataFrame:
    """The events in eight batches through a gate that fires at two of them: rows of each fire, and of the days in it."""
    rows = table(spark, sf, "events")
    size, root = rows.count(), f"{shared_root(spark)}/strandline/gate-{uuid.uuid4().hex}"
    for k in range(8):
        rows.where(F.col("event_id") % 8 == k).coalesce(1).write.parquet(f"{root}/in/part={k}")
    stream = st.observations(spark, f"{root}/in/*", rows.schema)
    st.gated(stream, size // 8 + 1, lambda found, fire: found.groupBy(F.lit(fire).alias("fire")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{root}/out/fire={fire}"), f"{root}/gate")
    return spark.read.schema("fire long, n long").parquet(f"{root}/out/*")


def stream_reservoir(spark: SparkSession, sf: str) -> DataFrame:
    """A sample of twenty events of each type, kept from batch to batch."""
    return st.folded(_events(spark, sf), st.reservoirs(["event_type"], "event_id", 20)).select("event_type", "event_id", "h")


def stream_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Running centroids of the labels' vectors."""
    path = f"{sf}/embeddings.parquet"
    vectors = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path + "*")
    kept = st.folded(vectors, st.running_centroids("label", "embedding"))
    return kept.select(F.col("label").cast("long").alias("label"), F.col("i").cast("long").alias("i"), F.round(F.col("s") / F.col("n"), 6).alias("c"), "n")


QUERIES = {f.__name__: f for f in (stream_label_counts, stream_tumbling, stream_sliding, stream_session, stream_incremental_posterior, stream_transitions, stream_gated, stream_reservoir, stream_centroids)}

ORACLE_SQL = {
    "stream_gated": "SELECT k AS fire, (SELECT count(*) FROM events WHERE event_id % 8 < 2) AS n FROM range(0, 4) t(k)",
    "stream_reservoir": f"WITH h AS (SELECT event_type, event_id, {_h('event_id')} AS h FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) AS k FROM h) SELECT event_type, event_id, h FROM r WHERE k <= 20",
    "stream_centroids": "WITH x AS (SELECT label::BIGINT AS label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, i, round(avg(v), 6) AS c, count(*) AS n FROM x GROUP BY label, i",
    "stream_label_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "stream_tumbling": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_sliding": "WITH w AS (SELECT date_trunc('day', ts) - INTERVAL (k) DAY AS start, value FROM events, (VALUES (0), (1)) v(k)) SELECT start, round(avg(value), 6) AS mean, count(*) AS n FROM w GROUP BY 1",
    "stream_session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_incremental_posterior": "SELECT event_type, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS p FROM events GROUP BY 1",
    "stream_transitions": "WITH t AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) SELECT a, b, count(*) AS n FROM t WHERE a <> b GROUP BY ALL",
}
