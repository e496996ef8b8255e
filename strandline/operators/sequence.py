"""Windows and segments over ordered observations, and joins of observations with intervals.

All operators take the columns that partition (a trajectory, a user) and order the rows. They
shuffle once by the partition; the joins with intervals shuffle by buckets of the ordered range.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .sampling import running_total


def _ordered(keys: list[str], order: str | list[str]):
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def noise_filter(rows: DataFrame, keys: list[str], order: str, value: str, width: int) -> DataFrame:
    """Adds smooth: mean of the ``width`` rows before, the row, and ``width - 1`` after."""
    w = _ordered(keys, order).rowsBetween(-width, width - 1)
    return rows.withColumn("smooth", F.avg(value).over(w))


def centred_delta(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds delta: absolute difference of the next and the previous value, 0 at both ends."""
    w = _ordered(keys, order)
    return rows.withColumn("delta", F.coalesce(F.abs(F.lead(value).over(w) - F.lag(value).over(w)), F.lit(0.0)))


def transitions(rows: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Successive rows of different states: keys, order, a (state before), b (state after)."""
    w = _ordered(keys, order)
    return rows.select(*keys, order, F.col(state).alias("a"), F.lead(state).over(w).alias("b")).where("a <> b")


def transition_matrix(pairs: DataFrame, *by: str) -> DataFrame:
    """Row-normalised matrix of (a, b): n, and p = n over the row's total, optionally per ``by``."""
    counts = pairs.groupBy(*by, "a", "b").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "a")))


def cumulative_transition_matrix(pairs: DataFrame, step: str) -> DataFrame:
    """The matrix over all steps up to each one; a pair that a step lacks keeps its last count."""
    steps = pairs.select(step).distinct()
    kinds = pairs.select("a", "b").distinct()
    counts = pairs.groupBy(step, "a", "b").agg(F.count("*").alias("n"))
    spine = steps.crossJoin(F.broadcast(kinds)).join(counts, [step, "a", "b"], "left")
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("a", "b").orderBy(step))
    spine = spine.withColumn("total", running).where("total > 0").drop("n")
    return spine.withColumn("p", F.col("total") / F.sum("total").over(Window.partitionBy(step, "a")))


def dwell_segments(rows: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Runs of one state: keys, seg (0, 1, ...), state, first and last order value, length, previous and next state."""
    w = _ordered(keys, order)
    changed = F.coalesce((F.col(state) != F.lag(state).over(w)).cast("int"), F.lit(0))
    marked = rows.withColumn("changed", changed).withColumn("seg", F.sum("changed").over(w))
    runs = marked.groupBy(*keys, "seg").agg(F.first(state).alias("state"), F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length"))
    s = _ordered(keys, "seg")
    return runs.withColumns({"prev": F.lag("state").over(s), "next": F.lead("state").over(s)})


def boundary_windows(bounds: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Half-open windows between successive boundaries: keys, idx, start, end."""
    w = _ordered(keys, at)
    out = bounds.select(*keys, F.lag(at).over(w).alias("start"), F.col(at).alias("end"), (F.row_number().over(w) - 2).alias("idx"))
    return out.where("start is not null")


def linked(segments: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Adds prev_id and next_id of each segment."""
    w = _ordered(keys, order)
    return segments.withColumns({"prev_id": F.lag(name).over(w), "next_id": F.lead(name).over(w)})


def segment_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation, exact median and number of a segment's values."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.percentile(value, F.lit(0.5)).alias("median"), F.count(value).alias("n"))


def _state_ranks(rows: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Per segment: n, first and last state, and states by falling count, the higher state first among equals."""
    counts = rows.groupBy(*keys, state).agg(F.count("*").alias("c"), F.min(F.struct(order, state)).alias("lo"), F.max(F.struct(order, state)).alias("hi"))
    ranked = F.sort_array(F.collect_list(F.struct("c", F.col(state).alias("s"))), asc=False)
    return counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.min("lo")[state].alias("first"), F.max("hi")[state].alias("last"), ranked.alias("ranked"))


def segment_label10(rows: DataFrame, keys: list[str], order: str, state: str, theta: float = 0.9, either: bool = True) -> DataFrame:
    """``W<modal state>`` for a segment that stays in its state, ``T<modal state>`` for one in transition.

    It is in transition if the modal state's share is under theta or (``either``; else: and) its
    ends differ.
    """
    r = _state_ranks(rows, keys, order, state)
    top = F.get("ranked", 0)
    low, moved = top["c"] / F.col("n") < theta, F.col("first") != F.col("last")
    kind = F.when(low | moved if either else low & moved, "T").otherwise("W")
    return r.select(*keys, F.concat(kind, top["s"].cast("string")).alias("label"))


def segment_label25(rows: DataFrame, keys: list[str], order: str, state: str, theta: float = 0.75) -> DataFrame:
    """(state_a, state_b): modal state and runner-up if the modal share is under theta; else the ends if they
    differ and are the two top states; else the modal state twice."""
    r = _state_ranks(rows, keys, order, state)
    a, b = F.get("ranked", 0)["s"], F.get("ranked", 1)["s"]
    low = F.get("ranked", 0)["c"] / F.col("n") < theta
    ends = (F.col("first") != F.col("last")) & ((F.col("first") == a) | (F.col("first") == b)) & ((F.col("last") == a) | (F.col("last") == b))
    return r.select(*keys, F.when(~low & ends, F.col("first")).otherwise(a).alias("state_a"), F.when(low, F.coalesce(b, a)).when(ends, F.col("last")).otherwise(a).alias("state_b"))


def chunk_activity(rows: DataFrame, keys: list[str], index: str, state: str, base: str, size: int, level: float = 1.0) -> DataFrame:
    """Per chunk of ``size`` rows by index: level minus the share of the base state."""
    chunk = F.floor(F.col(index) / size).alias("chunk")
    return rows.groupBy(*keys, chunk).agg((F.lit(level) - F.avg((F.col(state) == base).cast("double"))).alias("activity"), F.count("*").alias("n"))


def compress_gaps(rows: DataFrame, keys: list[str], ts: str, limit: int = 1800) -> DataFrame:
    """Adds busy: seconds since the first row without idle gaps of more than ``limit`` seconds, and gap."""
    w = _ordered(keys, ts)
    gap = F.coalesce(F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.lag(ts).over(w).cast("timestamp")), F.lit(0))
    return rows.withColumn("gap", gap).withColumn("busy", F.sum(F.when(F.col("gap") > limit, 0).otherwise(F.col("gap"))).over(w))


def at_thresholds(rows: DataFrame, keys: list[str], order: str, amount: str, step: float) -> DataFrame:
    """The first row of each further ``step`` of the running sum: adds total and bucket.

    Amounts are added as decimals of six places, so a sum that is just a multiple of ``step`` is one whatever the order of
    addition. Null, NaN and infinite amounts add nothing.
    """
    w = _ordered(keys, order)
    exact = F.col(amount).try_cast("decimal(28,6)")
    totals = rows.withColumn("total", F.sum(exact).over(w).cast("double")).withColumn("bucket", F.floor(F.col("total") / step))
    return totals.withColumn("before", F.coalesce(F.lag("bucket").over(w), F.lit(0))).where("bucket > before").drop("before")


def settled(rows: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Rows whose state equals that of the two rows before and the two after."""
    w = _ordered(keys, order)
    test = F.lit(True)
    for k in (1, 2):
        test = test & (F.lag(state, k).over(w) == F.col(state)) & (F.lead(state, k).over(w) == F.col(state))
    return rows.withColumn("__settled", test).where("__settled").drop("__settled")


def burn_in(rows: DataFrame, keys: list[str], order: str, skip: int, most: int) -> DataFrame:
    """Rows ``skip`` to ``skip + most`` (end excluded) of each partition."""
    place = F.row_number().over(_ordered(keys, order)) - 1
    return rows.withColumn("place", place).where((F.col("place") >= skip) & (F.col("place") < skip + most))


def fluctuation(rows: DataFrame, keys: list[str], order: str, value: str, width: int) -> DataFrame:
    """Adds to_first (difference to the partition's first value), lag1..lagw (differences to earlier rows) and spread (population deviation of the last w)."""
    w = _ordered(keys, order)
    cols = {"to_first": F.col(value) - F.first(value).over(w), "spread": F.stddev_pop(value).over(w.rowsBetween(-(width - 1), 0))}
    cols |= {f"lag{k}": F.col(value) - F.lag(value, k).over(w) for k in range(1, width + 1)}
    return rows.withColumns(cols)


def rmsf(frames: DataFrame, vector: str, reference: DataFrame | None = None) -> DataFrame:
    """Root mean square fluctuation of each element of a vector, about ``reference`` (i, x) or its mean."""
    parts = frames.select(F.posexplode(vector).alias("i", "v"))
    if reference is None:
        return parts.groupBy("i").agg(F.stddev_pop("v").alias("rmsf"))
    away = parts.join(F.broadcast(reference), "i")
    return away.groupBy("i").agg(F.sqrt(F.avg((F.col("v") - F.col("x")) * (F.col("v") - F.col("x")))).alias("rmsf"))


def crossover(pairs: DataFrame, keys: list[str], difference: str) -> DataFrame:
    """Steepest point and zero crossing of each partition's sorted differences: steepest, slope and crossing rank."""
    ranked = pairs.select(*keys, F.col(difference).alias("d")).withColumn("rank", F.row_number().over(_ordered(keys, "d")))
    w = _ordered(keys, "rank")
    slope = (F.lead("d").over(w) - F.lag("d").over(w)) / 2
    ranked = ranked.withColumn("slope", slope)
    return ranked.groupBy(*keys).agg(
        F.max_by("rank", F.struct(F.coalesce("slope", F.lit(-1.0)), -F.col("rank"))).alias("steepest"), F.max("slope").alias("slope"), F.sum((F.col("d") < 0).cast("long")).alias("crossing"), F.count("*").alias("n")
    )


def interval_join(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, width: int, on: list[str] | None = None) -> DataFrame:
    """Points joined with the half-open intervals that hold them.

    Both sides are dealt to buckets of ``width`` (an interval to each bucket it touches), so the
    join is an equi-join with a residual test and not a nested loop. ``width`` should be about an
    interval's length; ``on`` are further equal columns.
    """
    span = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    held = intervals.where(F.col(end) > F.col(start)).withColumn("__bucket", F.explode(span))
    asked = points.withColumn("__bucket", F.floor(F.col(at) / width))
    return asked.join(held, ["__bucket", *(on or [])]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bucket")


def forward_fill(spine: DataFrame, events: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The last event's value at or before each row of the spine, null before the first: an as-of join by union and window."""
    asked = spine.select(*keys, F.col(at), F.lit(None).cast(events.schema[value].dataType).alias(value), F.lit(1).alias("__asked"))
    told = events.select(*keys, F.col(at), F.col(value), F.lit(0).alias("__asked"))
    w = _ordered(keys, [at, "__asked"]).rowsBetween(Window.unboundedPreceding, 0)
    filled = asked.unionByName(told).withColumn(value, F.last(value, ignorenulls=True).over(w))
    return filled.where("__asked = 1").drop("__asked")


def contact_matrix(events: DataFrame, keys: list[str], step: str, kind: str, frames: DataFrame) -> DataFrame:
    """State of each contact at each frame: 1 after it was formed (``+++``), 0 after it broke, 0 before its first event."""
    pairs = events.select(*keys).distinct()
    spine = pairs.crossJoin(F.broadcast(frames.select(step).distinct()))
    told = events.select(*keys, step, (F.col(kind) == "+++").cast("int").alias("on"))
    return forward_fill(spine, told, keys, step, "on").withColumn("on", F.coalesce("on", F.lit(0)))


def contact_counts(events: DataFrame, keys: list[str], step: str, kind: str, frames: DataFrame) -> DataFrame:
    """Per frame: how many contacts are on, and the number of pairs that ever have an event, without a row for each pair and frame.

    An event that changes its pair's state adds or takes one from its step on; frames read the running total.
    """
    on = F.when(F.col(kind) == "+++", 1).otherwise(0)
    change = on - F.coalesce(F.lag(on).over(_ordered(keys, step)), F.lit(0))
    changes = events.select(F.col(step).alias("step"), change.alias("change"), F.lit(0).alias("asked"))
    asked = frames.select(F.col(step).alias("step"), F.lit(0).alias("change"), F.lit(1).alias("asked")).distinct()
    summed = running_total(changes.unionByName(asked), [F.asc("step"), F.asc("asked")], F.col("change"), "contacts").where("asked = 1")
    pairs = F.broadcast(events.select(*keys).distinct().agg(F.count("*").alias("pairs")))
    return summed.crossJoin(pairs).select(F.col("step").alias(step), "contacts", "pairs")


def strided(rows: DataFrame, keys: list[str], order: str, stride: int, first: int = 0) -> DataFrame:
    """Every ``stride``-th row of each key in order, from the one at place ``first`` (from 0) on."""
    placed = rows.withColumn("__place", F.row_number().over(_ordered(keys, order)) - 1 - first)
    return placed.where((F.col("__place") >= 0) & (F.col("__place") % stride == 0)).drop("__place")


def index_windows(rows: DataFrame, index: str, size: int, slide: int) -> DataFrame:
    """Adds window (its number) for every sliding index window that holds the row; windows that run past the last index are left out."""
    top = rows.agg(F.max(index).alias("__top"))
    first = F.greatest(F.ceil((F.col(index) - size + 1) / slide), F.lit(0))
    held = F.filter(F.sequence(first, F.floor(F.col(index) / slide)), lambda k: k * slide + size <= F.col("__top") + 1)
    return rows.crossJoin(F.broadcast(top)).where(F.floor(F.col(index) / slide) >= first).withColumn("window", F.explode(held)).drop("__top")


def windowed_variance(rows: DataFrame, index: str, vector: str, size: int, slide: int) -> DataFrame:
    """Sample variance of each element in each sliding window: window, i, variance."""
    parts = index_windows(rows, index, size, slide).select("window", F.posexplode(vector).alias("i", "x"))
    return parts.groupBy("window", "i").agg(F.var_samp("x").alias("variance"))


def windowed_covariance(rows: DataFrame, index: str, vector: str, size: int, slide: int) -> DataFrame:
    """Sample covariance of each pair of elements i <= j in each sliding window."""
    v = F.col(vector)
    pairs = F.flatten(F.transform(v, lambda a, i: F.transform(F.slice(v, i + 1, F.size(v)), lambda b, k: F.struct(i.alias("i"), (i + k).alias("j"), a.alias("a"), b.alias("b")))))
    parts = index_windows(rows, index, size, slide).select("window", F.explode(pairs).alias("p")).select("window", "p.*")
    return parts.groupBy("window", "i", "j").agg(F.covar_samp("a", "b").alias("covariance"))


def drift_segments(rows: DataFrame, keys: list[str], order: str, vector: str, theta: float, least: int = 8) -> DataFrame:
    """Segments of frames that stay within theta (root mean square) of the segment's first frame: keys, seg, start, end, length.

    The first frame that strays opens the next segment, so the scan is sequential inside one
    trajectory; trajectories are independent groups. Segments of at most ``least`` frames are left out.
    """
    ship(rows.sparkSession)
    schema = rows.select(*keys, F.lit(0).cast("long").alias("seg"), F.col(order).alias("start"), F.col(order).alias("end"), F.lit(0).cast("long").alias("length")).schema

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None  # key, reference, segment number, start, end, length
        done = []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                key, at, x = tuple(getattr(row, k) for k in keys), getattr(row, order), np.asarray(getattr(row, vector), float)
                if state and state[0] == key and np.sqrt(((x - state[1]) ** 2).mean()) <= theta:
                    state[4], state[5] = at, state[5] + 1
                    continue
                if state and state[5] > least:
                    done.append((*state[0], *state[2:]))
                number = state[2] + 1 if state and state[0] == key else 0
                state = [key, x, number, at, at, 1]
            if len(done) > 1000:
                yield pd.DataFrame(done, columns=schema.names)
                done = []
        if state and state[5] > least:
            done.append((*state[0], *state[2:]))
        if done:
            yield pd.DataFrame(done, columns=schema.names)

    dealt = rows.select(*keys, order, vector).repartition(*keys).sortWithinPartitions(*keys, order)
    return dealt.mapInPandas(scan, schema)


def pairwise_segments(rows: DataFrame, keys: list[str], order: str, vector: str, theta: float) -> DataFrame:
    """Segments by the distances of a frame to all frames of its segment: keys, seg, start, end, length.

    A frame opens a segment if its root mean square distances to the segment's frames, without the
    last two, add up to over theta more than those of the frame two before it. The scan is
    sequential inside one trajectory and quadratic in a segment's length; trajectories are
    independent groups, of which a task holds one segment.
    """
    ship(rows.sparkSession)
    schema = rows.select(*keys, F.lit(0).cast("long").alias("seg"), F.col(order).alias("start"), F.col(order).alias("end"), F.lit(0).cast("long").alias("length")).schema

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, number, first, last, held, before = None, 0, None, None, [], [np.zeros(0), np.zeros(0)]
        done = []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                key, at, x = tuple(getattr(row, k) for k in keys), getattr(row, order), np.asarray(getattr(row, vector), float)
                far = np.sqrt(((np.array(held) - x) ** 2).mean(axis=1)) if held else np.zeros(0)
                ends = key != now or far[: max(0, len(held) - 2)].sum() - before[1].sum() > theta
                if ends:
                    if held:
                        done.append((*now, number, first, last, len(held)))
                    number = number + 1 if key == now else 0
                    now, first, held, far, before = key, at, [], np.zeros(0), [np.zeros(0), np.zeros(0)]
                held.append(x)
                last, before = at, [far, before[0]]
            if len(done) > 1000:
                yield pd.DataFrame(done, columns=schema.names)
                done = []
        if held:
            done.append((*now, number, first, last, len(held)))
        if done:
            yield pd.DataFrame(done, columns=schema.names)

    dealt = rows.select(*keys, order, vector).repartition(*keys).sortWithinPartitions(*keys, order)
    return dealt.mapInPandas(scan, schema)


def running_mean_segments(rows: DataFrame, keys: list[str], order: str, value: str, width: int, theta: float) -> DataFrame:
    """Adds seg: a new segment starts where the running mean of the last ``width`` values moves by more than theta from row to row."""
    w = _ordered(keys, order)
    rows = rows.withColumn("running", F.avg(value).over(w.rowsBetween(-(width - 1), 0)))
    jump = F.coalesce((F.abs(F.col("running") - F.lag("running").over(w)) > theta).cast("int"), F.lit(0))
    return rows.withColumn("jump", jump).withColumn("seg", F.sum("jump").over(w)).drop("jump")
