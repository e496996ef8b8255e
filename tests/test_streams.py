"""Streams that are stopped in the middle and go on: every row counts once, and state survives."""

import pytest
from pyspark.sql import functions as F
from strandline.streaming import streams as st

SCHEMA = "id long, key string, x array<double>"


def arrive(spark, folder, sizes, first=0):
    at = first
    for k, n in enumerate(sizes):
        rows = [(i, "ab"[i % 2], [float(i), 1.0]) for i in range(at, at + n)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{first:04d}-{k:04d}")
        at += n
    return at


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def results(spark, folder):
    rows = spark.read.schema("fire long, id long").parquet(f"{folder}/out/*").collect()
    fires = {}
    for r in rows:
        fires.setdefault(r["fire"], []).append(r["id"])
    return fires


def writer(folder, stops=None):
    def act(rows, fire):
        rows.select(F.lit(fire).cast("long").alias("fire"), "id").write.mode("overwrite").parquet(f"{folder}/out/{fire}")
        if fire == stops:
            raise RuntimeError("stopped")

    return act


def test_gate_groups_by_least_and_most(spark, tmp_path):
    folder = str(tmp_path)
    n = arrive(spark, folder, [3, 3, 3, 3, 9, 1])
    st.gated(stream(spark, folder), 4, writer(folder), f"{folder}/gate", most=7)
    fires = results(spark, folder)
    assert sorted(i for f in fires.values() for i in f) == list(range(n))
    sizes = [len(fires[k]) for k in sorted(fires)]
    assert all(s >= 4 for s in sizes[:-1]) and all(s <= 7 or s == 9 for s in sizes)


@pytest.mark.parametrize("stops", [0, 1])
def test_gate_that_is_stopped_between_two_fires_acts_once_on_each_row(spark, tmp_path, stops):
    """It stops after the rows were written and before the fire is marked as done, then goes on with more files."""
    folder = str(tmp_path)
    first = arrive(spark, folder, [2, 2, 2, 2])
    with pytest.raises(Exception, match="stopped"):
        st.gated(stream(spark, folder), 4, writer(folder, stops), f"{folder}/gate")
    assert len(results(spark, folder)) == stops + 1
    n = arrive(spark, folder, [2, 3], first)
    st.gated(stream(spark, folder), 4, writer(folder), f"{folder}/gate")
    fires = results(spark, folder)
    assert sorted(i for f in fires.values() for i in f) == list(range(n)) and sorted(fires) == [0, 1, 2]
    st.gated(stream(spark, folder), 4, writer(folder), f"{folder}/gate")
    assert results(spark, folder) == fires


def test_state_goes_on_after_a_stop(spark, tmp_path):
    folder = str(tmp_path)
    arrive(spark, folder, [5, 5])
    keep, calls = st.running_centroids("key", "x"), []

    def failing(state, batch):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return keep(state, batch)

    with pytest.raises(Exception, match="stopped"):
        st.folded(stream(spark, folder), failing, f"{folder}/sums")
    arrive(spark, folder, [4], 10)
    sums = st.folded(stream(spark, folder), keep, f"{folder}/sums")
    assert {(r["key"], r["i"]): (r["s"], r["n"]) for r in sums.collect()} == {("a", 0): (42.0, 7), ("a", 1): (7.0, 7), ("b", 0): (49.0, 7), ("b", 1): (7.0, 7)}
    from strandline.operators.sampling import bottom_k

    sample = st.folded(stream(spark, folder), st.reservoirs(["key"], "id", 3), f"{folder}/sample")
    whole = bottom_k(spark.read.schema(SCHEMA).parquet(f"{folder}/in/*"), ["key"], "id", 3)
    assert {r["id"] for r in sample.collect()} == {r["id"] for r in whole.collect()}
