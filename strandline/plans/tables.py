"""The driver's tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames: vec_id, label and x (array of double)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", vec.doubles("embedding").alias("x"))


def axes(rows: DataFrame, n: int) -> DataFrame:
    """The first n elements of x as columns x0..x<n-1>."""
    return rows.select("vec_id", "label", *(F.get("x", k).alias(f"x{k}") for k in range(n)))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


#: SQL fragments: frames in long form, and per-label centroids.
LONG = "x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
CENTRES = LONG + ", c AS (SELECT label AS state, i, avg(v) AS v FROM x GROUP BY ALL), d AS (SELECT x.vec_id, any_value(x.label) AS label, c.state, sqrt(sum((x.v - c.v) * (x.v - c.v))) AS d FROM x JOIN c USING (i) GROUP BY x.vec_id, c.state)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and integers as long, for comparison with another engine."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        out.append((F.round(c, digits) if kind in ("double", "float") else c.cast("long") if kind in ("int", "smallint", "tinyint") else c).alias(f.name))
    return df.select(*out)
