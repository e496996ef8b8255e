"""Readers of text logs: segment boundaries, contact events, labels, benchmarks and outcomes.

All scan with ``read.text`` and parse with built-in functions, so files are split among tasks.
Lines that do not fit are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line"))


def segment_bounds(lines: DataFrame) -> DataFrame:
    """(file, bound): the seventh word of lines that start with ``Output``, and 0 for each file."""
    words = F.split("line", r"\s+")
    found = lines.where(F.startswith("line", F.lit("Output"))).select("file", F.get(words, 6).try_cast("long").alias("bound")).where("bound is not null")
    return found.unionByName(lines.select("file", F.lit(0).cast("long").alias("bound")).distinct()).distinct()


def contact_events(lines: DataFrame, kinds: tuple[str, ...] = ("+++", "---")) -> DataFrame:
    """(file, kind, step, r1, r2) of lines ``+++ step residue residue`` and ``---``; residues become zero-based."""
    words = F.split("line", r"\s+")
    out = lines.select("file", F.get(words, 0).alias("kind"), F.get(words, 1).try_cast("long").alias("step"), (F.get(words, 2).try_cast("int") - 1).alias("r1"), (F.get(words, 3).try_cast("int") - 1).alias("r2"))
    return out.where(F.col("kind").isin(*kinds) & F.col("step").isNotNull() & F.col("r1").isNotNull() & F.col("r2").isNotNull())


def label_lines(lines: DataFrame) -> DataFrame:
    """(file, time, state) of lines ``time state``."""
    words = F.split("line", r"\s+")
    out = lines.select("file", F.get(words, 0).try_cast("double").alias("time"), F.get(words, 1).try_cast("int").alias("state"))
    return out.where("time is not null and state is not null")


def benchmark_lines(lines: DataFrame) -> DataFrame:
    """(ctlid, num, runtime, deltatime, label) of lines with five fields between commas."""
    f = F.split("line", ",")
    out = lines.where(F.size(f) == 5).select(F.get(f, 0).alias("ctlid"), F.get(f, 1).try_cast("long").alias("num"), F.get(f, 2).try_cast("double").alias("runtime"), F.get(f, 3).try_cast("double").alias("deltatime"), F.get(f, 4).alias("label"))
    return out.where("num is not null")


def outcome_lines(lines: DataFrame) -> DataFrame:
    """(bid, target, actual, labels) of lines ``BASIN,bid,target,actual,labels``."""
    f = F.split("line", ",")
    return lines.where((F.get(f, 0) == "BASIN") & (F.size(f) >= 5)).select(F.get(f, 1).alias("bid"), F.get(f, 2).alias("target"), F.get(f, 3).alias("actual"), F.get(f, 4).alias("labels"))


def sections(lines: DataFrame, order: str, heading: str) -> DataFrame:
    """Adds section: the last line that fits the pattern ``heading`` at or before each line of the file."""
    w = Window.partitionBy("file").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.regexp_extract("line", heading, 0) != "", F.regexp_extract("line", heading, 0))
    return lines.withColumn("section", F.last(head, ignorenulls=True).over(w))


def key_values(lines: DataFrame, order: str, separator: str = ":") -> DataFrame:
    """(file, values): a map of the ``key: value`` lines of each file; the last value of a key by ``order`` counts."""
    at = F.locate(separator, F.col("line"))
    pairs = lines.where(at > 1).select("file", F.col(order).alias("at"), F.trim(F.expr("left(line, locate('" + separator + "', line) - 1)")).alias("k"), F.trim(F.expr("substring(line, locate('" + separator + "', line) + 1)")).alias("v"))
    last = pairs.groupBy("file", "k").agg(F.max_by("v", F.struct("at", "v")).alias("v"))
    return last.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("values"))


def job_rows(lines: DataFrame, order: str, job: str, accounting: DataFrame, separator: str = ":") -> DataFrame:
    """A row for each job's log with what the scheduler recorded of it: (file, values, and the columns of ``accounting``).

    ``job`` is the key under which a log names its job; ``accounting`` has it as a column. Jobs that were not accounted for have nulls.
    """
    logged = key_values(lines, order, separator).withColumn(job, F.try_element_at("values", F.lit(job)).try_cast(accounting.schema[job].dataType))
    return logged.join(accounting, job, "left")


def read_segment_bounds(spark: SparkSession, path: str) -> DataFrame:
    return segment_bounds(_lines(spark, path))


def read_contact_events(spark: SparkSession, path: str) -> DataFrame:
    return contact_events(_lines(spark, path))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return label_lines(_lines(spark, path))


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    return benchmark_lines(_lines(spark, path))


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    return outcome_lines(_lines(spark, path))
