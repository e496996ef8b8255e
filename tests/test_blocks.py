"""Distances of blocks of rows: the same pairs, ranks and votes as row by row, with copies, ties and far-off vectors."""

import numpy as np
import pytest

from strandline.operators import blocks, learning, spatial

SCHEMA = "id long, label int, x array<double>"


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(spatial, "QUERY_BYTES", 1_000)
    monkeypatch.setattr(learning, "QUERY_BYTES", 2_000)


def points(n=90, size=5, far=0.0):
    r = np.random.default_rng(2)
    x = r.normal(size=(n, size)) + far
    x[n // 2 :] = x[: n - n // 2]
    return [(k, None if k % 11 == 0 else k % 3, v.tolist()) for k, v in enumerate(x)]


def added(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return total**0.5


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_pair_statistics(spark, small, far):
    data = [*points(far=far), (4, 1, [far] * 5), (200, 2, None), (201, 7, [far] * 5)]
    got = {r["label"]: tuple(r)[1:] for r in blocks.pair_statistics(spark.createDataFrame(data, SCHEMA), "id", "x", "label").collect()}
    for label in (0, 1, 2):
        d = [added(x, y) for a, la, x in data for b, lb, y in data if la == lb == label and a < b and x and y]
        assert got[label] == pytest.approx((len(d), sum(d) / len(d), min(d), max(d)), rel=1e-9)
    assert set(got) == {0, 1, 2}


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_nearest_rows_with_copies(spark, small, far):
    data = points(far=far)
    rows = spark.createDataFrame([*data, (500, 1, None)], SCHEMA)
    got = [tuple(r) for r in spatial.nearest_rows(rows, rows.where("id % 4 = 0"), "id", "x", 3).orderBy("query", "rank").collect()]
    want = []
    for q, _, x in data[::4]:
        best = sorted((added(x, y), k) for k, _, y in data if k != q)[:3]
        want += [(q, k, d, rank + 1) for rank, (d, k) in enumerate(best)]
    assert got == want


def test_names_are_ordered_as_values(spark, small):
    rows = spark.createDataFrame([(n, [0.0]) for n in ("b", "a", "ä", "B", "aa")], "id string, x array<double>")
    got = [r["id"] for r in spatial.nearest_rows(rows, rows.where("id = 'b'"), "id", "x", 4).orderBy("rank").collect()]
    assert got == ["B", "a", "aa", "ä"]


def test_votes_are_those_of_the_neighbours(spark, small):
    rows = spark.createDataFrame(points(200), SCHEMA)
    asked = rows.where("id % 5 = 0")
    near = learning.lsh_neighbours(rows, asked, "id", "x", 1.5)
    want = sorted(map(str, learning.vote(near, rows.select("id", "label"), "id").collect()))
    assert sorted(map(str, learning.lsh_vote(rows, asked, "id", "x", "label", 1.5).collect())) == want and len(want) == 40


def test_vectors_must_be_of_one_length(spark, small):
    rows = spark.createDataFrame([(1, 1, [1.0]), (2, 1, [1.0, 2.0])], SCHEMA)
    with pytest.raises(Exception, match="different lengths"):
        blocks.pair_statistics(rows, "id", "x", "label").collect()
