"""Connected components against a plain union-find, with few and with many edges a task."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import lists
from strandline.llm._scratch import Scratch
from strandline.llm.blocks import Index, link, link_small
from strandline.llm.components import components


def plain(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in {v for e in edges if e[0] != e[1] for v in e}}


def cases():
    r = random.Random(3)
    return {
        "random": ([(r.randrange(400), r.randrange(400)) for _ in range(330)], 40),
        "chain": ([(i + 1, i) for i in r.sample(range(300), 300)], 25),
        "hub": ([(0, i) for i in range(1, 300)] + [(500, 501)], 30),
        "one task": ([(i, i * 7 % 101) for i in range(100)], 1 << 20),
        "loops only": ([(4, 4)], 10),
    }


@pytest.mark.parametrize("name", cases())
def test_components(spark, name):
    edges, most = cases()[name]
    df = spark.createDataFrame(edges, "a long, b long").repartition(8)
    scratch = Scratch(spark, "test")
    found = components(scratch.keep(df, "edges"), scratch, most).collect()
    assert {r.id: r.component for r in found} == plain(edges) and len(found) == len(plain(edges))


def test_empty(spark):
    df = spark.createDataFrame([(None, 1)], "a long, b long")
    assert components(df, Scratch(spark, "test")).count() == 0


def test_partners_against_all_pairs():
    """Bitmaps and wanted items lose no link, at sizes about the threshold."""
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = []
    for k in range(80):
        own = base[r.random(60) < r.uniform(0.7, 1)] if k % 2 else r.integers(0, 1 << 63, k + 1, dtype=np.uint64)
        sets.append(np.unique(np.concatenate([own, r.integers(0, 1 << 63, k % 5, dtype=np.uint64)])))
    index = Index(sets)
    for i, s in enumerate(sets):
        both = [np.intersect1d(s, t).size for t in sets]
        want = [j for j, t in enumerate(sets) if j != i and 100 * both[j] >= 80 * (s.size + t.size - both[j]) and both[j]]
        assert index.partners(i, 80, np.ones(len(sets), dtype=bool)).tolist() == want


def test_small_blocks_together_equal_each_by_itself():
    rng = np.random.default_rng(7)
    sets, blocks, roots = [], [], []
    for block in range(120):
        n, base = int(rng.integers(1, 9)), rng.choice(40, 25, replace=False)
        own = [np.sort(rng.choice(base, int(rng.integers(0, 26)), replace=False)).astype(np.uint64) for _ in range(n)]
        own += [own[0]] * int(rng.integers(0, 2))
        roots += (link(own, 80)[0] + len(sets)).tolist()
        sets += own
        blocks += [block] * len(own)
    assert link_small(sets, np.array(blocks), 80).tolist() == roots


def test_pairs_compared_together_equal_each_by_itself():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 300, int(rng.integers(1, 90)))).astype(np.uint64) for _ in range(200)]
    for k in range(0, 200, 4):
        sets[k + 1] = np.unique(np.concatenate([sets[k][: -1 - k % 5], sets[k + 1][: k % 3]]))
    n = np.array([s.size for s in sets])
    maps = lists.bitmaps(np.concatenate(sets), n)
    data = [m.as_py() for m in maps]
    offsets = np.concatenate([[0], np.cumsum([len(m) for m in data])])
    data, pairs = np.frombuffer(b"".join(data), np.uint8), np.arange(0, 200, 2)
    whole = [m.as_py() for m in maps]
    for exact in (True, False):
        got = lists._pairs_admitted(n, offsets, data, pairs, pairs + 1, 80, exact)
        assert got.tolist() == [lists._two(n[k : k + 2].tolist(), whole[k : k + 2], 80, exact) for k in pairs] and 10 < got.sum() < 100
    groups = np.repeat(np.arange(50), [1 + k % 7 for k in range(50)])[:200]
    batch = pa.RecordBatch.from_arrays([pa.array(groups), pa.array(np.arange(groups.size) * 3 - 50), pa.array(n[: groups.size]), maps.slice(0, groups.size)], ["group", "id", "n", "bits"])
    for exact in (True, False):
        found, rest = lists._small_groups(batch, 80, exact)
        want, left = set(), 0
        for g in np.unique(groups):
            at = np.flatnonzero(groups == g)
            if at[0] == 0 or at[-1] == groups.size - 1 or at.size == 1:
                left += at.size
                continue
            want |= {frozenset(int(at[i]) * 3 - 50 for i in c) for c in lists.clusters(n[at].tolist(), [whole[i] for i in at], 80, exact)}
        got = {}
        for r in found.to_pylist():
            got.setdefault(r["cluster"], []).append(r)
        assert {frozenset(r["id"] for r in rows) for rows in got.values()} == want and rest.num_rows == left
        assert all(r["head"] == min(x["id"] for x in rows) and r["members"] == len(rows) for rows in got.values() for r in rows)
