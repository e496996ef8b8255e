"""Streams over observation files: counts, windows, sessions, transitions and state kept in tables.

Sources are folders (or globs) of Parquet files. Time columns without zone are cast to
timestamps, because watermarks need them. Queries that keep tables do so per batch id, so a batch
that is run again replaces its own part and nothing is counted twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import shared_root
from ..operators.sampling import bottom_k
from ..session import ship


def observations(spark: SparkSession, path: str, schema, ts: str = "ts", files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files with its time column as timestamp."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def _root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/strandline/stream-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run an aggregating stream over all available files and read its last result back."""
    spark, root = stream.sparkSession, _root(stream.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(stream.schema.add("batch", "long")).option("basePath", f"{root}/out").parquet(f"{root}/out")
    if mode == "complete":
        last = found.agg(F.max("batch").alias("last"))
        found = found.join(F.broadcast(last), F.col("batch") == F.col("last")).drop("last")
    return found.drop("batch")


def label_counts(stream: DataFrame, label: str) -> DataFrame:
    return stream.groupBy(label).agg(F.count("*").alias("n"))


def tumbling(stream: DataFrame, ts: str, size: str, late: str, *keys: str) -> DataFrame:
    """Rows per tumbling window and keys: start and n."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")


def sliding(stream: DataFrame, ts: str, size: str, slide: str, late: str, value: str) -> DataFrame:
    """Mean of a value in sliding windows."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, size, slide)).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "mean", "n")


def sessions(stream: DataFrame, ts: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Sessions of each key that end after a gap without rows: start, end and n."""
    counted = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def incremental_posterior(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Label counts and shares after all batches, kept as one table of counts for each batch."""
    root = _root(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(label).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{root}/counts/batch={batch_id}")

    stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    schema = stream.select(label).schema.add("n", "long").add("batch", "long")
    counts = spark.read.schema(schema).option("basePath", f"{root}/counts").parquet(f"{root}/counts")
    merged = counts.groupBy(label).agg(F.sum("n").alias("n"))
    return merged.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))


class Gate:
    """Groups the batches of a stream into fires of at least ``least`` and, as far as single batches allow, at most ``most`` rows.

    All it knows is in tables under ``root``, so a stream that was stopped anywhere goes on from
    them. Batches are taken in order until the next one would pass ``most``; a single batch over
    ``most`` is taken alone. A fire is planned (its batches are written down), then acted on, then
    marked as done. A fire that is planned but not done is acted on again with the same number and
    the same rows, hence ``act(rows, fire)`` should write by the number of the fire, over what it
    may have written before; then every row counts once.
    """

    def __init__(self, spark: SparkSession, schema, root: str, least: int, act: Callable[[DataFrame, int], None], most: int | None = None):
        self.spark, self.schema, self.root, self.least, self.act, self.most = spark, schema, root, least, act, most
        for name, columns in self._TABLES.items():
            spark.createDataFrame([], columns).write.mode("append").parquet(f"{root}/{name}/start=0")

    _TABLES = {"arrived": "batch long, n long", "planned": "fire long, batch long", "done": "fire long"}

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._TABLES[name]).parquet(f"{self.root}/{name}/*")

    def _write(self, name: str, rows: list[tuple], key: int) -> None:
        self.spark.createDataFrame(rows, self._TABLES[name]).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{name}/at={key}")

    def offer(self, batch: DataFrame, batch_id: int) -> None:
        """Keeps a batch and fires if enough has come; the same batch offered again replaces itself, or does nothing if it was planned."""
        if not self._read("planned").where(F.col("batch") == batch_id).limit(1).count():
            at = f"{self.root}/buffer/batch={batch_id}"
            batch.write.mode("overwrite").parquet(at)
            self._write("arrived", [(batch_id, self.spark.read.schema(self.schema).parquet(at).count())], batch_id)
        self.fire()

    def fire(self, ended: bool = False) -> None:
        """Acts on what is planned but not done, then on as many groups as are full (on all that is left if ``ended``)."""
        planned = self._read("planned")
        open_ = planned.join(self._read("done"), "fire", "left_anti").groupBy("fire").agg(F.sort_array(F.collect_list("batch")).alias("batches")).orderBy("fire").collect()
        for row in open_:
            self._act(row["fire"], row["batches"])
        last = planned.agg(F.max("fire")).first()[0]
        number = 0 if last is None else last + 1
        waiting = [(r["batch"], r["n"]) for r in self._read("arrived").join(planned, "batch", "left_anti").orderBy("batch").collect()]
        while waiting:
            rows, taken = 0, 0
            for _, n in waiting:
                if taken and self.most is not None and rows + n > self.most:
                    break
                rows, taken = rows + n, taken + 1
                if self.most is None and rows >= self.least:
                    break
            if rows < self.least and not ended and taken == len(waiting):
                return
            batches = [b for b, _ in waiting[:taken]]
            self._write("planned", [(number, b) for b in batches], number)
            self._act(number, batches)
            number, waiting = number + 1, waiting[taken:]

    def _act(self, number: int, batches: list[int]) -> None:
        self.act(self.spark.read.schema(self.schema).parquet(*(f"{self.root}/buffer/batch={b}" for b in batches)), number)
        self._write("done", [(number,)], number)


def gated(stream: DataFrame, least: int, act: Callable[[DataFrame, int], None], root: str | None = None, most: int | None = None) -> None:
    """Runs a stream through a ``Gate`` over all that is there; the last fire takes the rest. With the same ``root`` it goes on where it was stopped."""
    spark = stream.sparkSession
    root = root or _root(spark)
    gate = Gate(spark, stream.schema, root, least, act, most)
    stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(gate.offer).trigger(availableNow=True).start().awaitTermination()
    gate.fire(ended=True)


def folded(stream: DataFrame, fold: Callable[[DataFrame | None, DataFrame], DataFrame], root: str | None = None) -> DataFrame:
    """The state after all batches, where ``fold(state, batch)`` gives the next one (the first state is None).

    Each batch writes its state under its own number from the one before it, so a batch that is run
    again after a stop starts from the same state. With the same ``root`` a later run goes on. Only
    the last two states are of use; older ones may be removed.
    """
    spark = stream.sparkSession
    root = root or _root(spark)
    numbers = f"{root}/numbers"
    spark.createDataFrame([], "batch long").write.mode("append").parquet(f"{numbers}/start=0")

    def before(batch_id: int | None) -> DataFrame | None:
        rows = spark.read.schema("batch long").parquet(f"{numbers}/*")
        last = (rows if batch_id is None else rows.where(F.col("batch") < batch_id)).agg(F.max("batch")).first()[0]
        return None if last is None else spark.read.parquet(f"{root}/state/batch={last}")

    def write(batch: DataFrame, batch_id: int) -> None:
        fold(before(batch_id), batch).write.mode("overwrite").parquet(f"{root}/state/batch={batch_id}")
        spark.createDataFrame([(batch_id,)], "batch long").write.mode("overwrite").parquet(f"{numbers}/at={batch_id}")

    stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return before(None)


def reservoirs(keys: list[str], row_id: str, k: int, seed: int = 0) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A fold that keeps a uniform sample of k rows of each key."""
    return lambda state, batch: bottom_k(batch if state is None else state.select(*batch.columns).unionByName(batch), keys, row_id, k, seed)


def running_centroids(key: str, vector: str) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A fold that keeps, for each key and dimension, the sum s and the number n; centroids are s / n."""

    def fold(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        parts = batch.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
        both = parts if state is None else state.unionByName(parts)
        return both.groupBy(key, "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))

    return fold


def keyed_transitions(stream: DataFrame, key: str, ts: str, state: str) -> DataFrame:
    """Successive different states of each key (key, at, a, b) across batches: the last state of a key is kept between them."""
    ship(stream.sparkSession)
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, at timestamp, a string, b string"

    def step(group, frames: Iterable[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        last = kept.get[0] if kept.exists else None
        rows = pd.concat(list(frames)).sort_values(ts, kind="stable")
        out = []
        for at, now in zip(rows[ts], rows[state]):
            if last is not None and now != last:
                out.append((group[0], at, last, now))
            last = now
        kept.update((last,))
        yield pd.DataFrame(out, columns=[key, "at", "a", "b"])

    return stream.groupBy(key).applyInPandasWithState(step, schema, "last string", "append", "NoTimeout")
