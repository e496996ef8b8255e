"""Itemsets of any size, closed sets and maintained lattices against plain enumeration and rebuilding."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from strandline.operators import bitmaps, itemsets, lattice, maintained
from strandline.operators.concepts import formal_concepts
from strandline.operators.maxminer import inside, least_count, max_miner

BINS = (-1.0, 1.0, 20)


def baskets(seed, n=60, items=10, patterns=((0, 1, 2, 3, 4, 5), (2, 3, 6, 7), (1, 8, 9))):
    """Rows that hold planted patterns, one of six items, among noise."""
    rng = random.Random(seed)
    return [sorted({x for p in patterns if rng.random() < 0.4 for x in p} | {x for x in range(items) if rng.random() < 0.1}) for _ in range(n)]


def table(spark, rows, first=0):
    return spark.createDataFrame([(first + t, i) for t, items in enumerate(rows) for i in items], "tid long, item int")


def frequent(rows, least):
    items = sorted({i for r in rows for i in r})
    out = {}
    for k in range(1, len(items) + 1):
        level = {c: n for c in itertools.combinations(items, k) if (n := sum(set(c) <= set(r) for r in rows)) >= least}
        if not level:
            break
        out |= level
    return out


def got(df):
    rows = [(tuple(r["items"]), r["support"]) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize(("seed", "least"), [(0, 6), (1, 10), (2, 3)])
def test_max_miner_equals_enumeration(spark, seed, least):
    rows = baskets(seed)
    every = frequent(rows, least)
    maximal = {s: n for s, n in every.items() if not any(set(s) < set(t) for t in every)}
    assert max(map(len, maximal)) >= 6
    found, missed = max_miner(table(spark, rows), least)
    assert got(found) == maximal
    for s, n in got(missed).items():
        assert n < least and n == sum(set(s) <= set(r) for r in rows)
    nodes = itemsets.lattice_nodes(found)
    assert {tuple(r["items"]) for r in nodes.collect()} == set(every)


def test_max_miner_ends(spark):
    assert got(max_miner(table(spark, [[1], [2]]), 2)[0]) == {}
    assert got(max_miner(table(spark, [[1], [1, 2]]), 2)[0]) == {(1,): 2}
    assert got(max_miner(table(spark, []), 1)[0]) == {}
    repeated = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", None), ("c", "y"), ("c", "x")], "tid string, item string")
    assert got(max_miner(repeated, 2)[0]) == {("x",): 2, ("y",): 2}
    assert got(max_miner(repeated, 1)[0]) == {("x", "y"): 1}


def test_frequent_itemsets_of_any_size(spark):
    rows = baskets(3)
    assert got(itemsets.frequent_itemsets(table(spark, rows), 8)) == frequent(rows, 8)
    assert got(itemsets.frequent_itemsets(table(spark, rows), 8, 2)) == {s: n for s, n in frequent(rows, 8).items() if len(s) <= 2}
    assert got(itemsets.frequent_itemsets(table(spark, rows), 8, strict=True)) == frequent(rows, 9)


def test_inside(spark):
    def sets(*x):
        return spark.createDataFrame([(list(s),) for s in x], "items array<int>")

    found = sets((1, 2, 3), (4,), (5, 6))
    assert {tuple(r["items"]) for r in inside(sets((1, 3), (4,), (1, 4), (5, 6), (7,)), found).collect()} == {(1, 3), (4,), (5, 6)}
    assert {tuple(r["items"]) for r in inside(sets((1, 3), (4,), (5, 6)), found, strictly=True).collect()} == {(1, 3)}


def test_shares():
    assert [least_count(None, s, n) for s, n in ((0.02, 500), (0.02, 501), (0.1, 0), (0.5, 3))] == [10, 11, 1, 2]


def plain_concepts(rows, least):
    rows = [frozenset(r) for r in rows if r]
    closed = set(rows)
    while more := {a & b for a in closed for b in rows} - closed:
        closed |= more
    out = {tuple(sorted(c)): sum(c <= r for r in rows) for c in closed}
    return {c: n for c, n in out.items() if n >= least}


@pytest.mark.parametrize(("seed", "least", "items"), [(0, 1, 9), (1, 4, 12), (2, 2, 130)])
def test_close_by_one_equals_plain(spark, seed, least, items):
    rng = random.Random(seed)
    rows = [r[:7] if items > 100 else r for r in baskets(seed, n=40, items=items)]
    rows = [sorted({x * 11 % items for x in r}) for r in rows] + [[], sorted(rng.sample(range(items), 3))]
    assert got(formal_concepts(table(spark, rows), least)) == plain_concepts(rows, least)


def test_close_by_one_ends(spark):
    assert got(formal_concepts(table(spark, []))) == {}
    assert got(formal_concepts(table(spark, [[1, 2], [1, 2]]))) == {(1, 2): 2}
    assert got(formal_concepts(table(spark, [[1], [2]]), 3)) == {}


def lattice_of(spark, rows, values, share=0.1):
    x = spark.createDataFrame([(t, k, v) for t, row in enumerate(values) for k, v in enumerate(row)], "tid long, feature int, x double")
    return maintained.build(table(spark, rows), x, len(rows), share, BINS)


def state(a):
    return {
        "nodes": got(a.nodes),
        "rows": {(tuple(r["items"]), r["tid"]) for r in a.rows.collect()},
        "edges": {(tuple(r["child"]), tuple(r["parent"])): pytest.approx(r["emd"], abs=1e-9) for r in a.edges.collect()},
    }


def numbers(rng, rows):
    return [[rng.uniform(-1.1, 1.1) + (0.5 if k in r else 0) for k in range(10)] for r in rows]


def test_merge_equals_rebuild(spark):
    """Batches of different patterns, so that each has nodes that the other lacks, and some fall under the share."""
    rng, n, m = random.Random(4), 40, 15
    a = baskets(5, n, patterns=((0, 1, 2, 3), (4, 5)))
    b = baskets(6, m, patterns=((0, 1, 6, 7), (4, 5, 8)))
    va, vb = numbers(rng, a), numbers(rng, b)
    one, two = lattice_of(spark, a, va), lattice_of(spark, b, vb)
    merged = maintained.merge(one, two)
    assert state(merged) == state(lattice_of(spark, a + b, va + vb))
    assert set(got(one.nodes)) != set(got(merged.nodes)) and merged.n == n + m
    whole = [set(r) for r in a + b]
    assert all(k == sum(set(s) <= r for r in whole) for s, k in got(merged.low).items())
    again = maintained.merge(merged, two)
    assert got(again.nodes) == {s: k for s, k in frequent(a + b + b, again.least).items()}
    with pytest.raises(ValueError):
        maintained.merge(one, maintained.Lattice(**{**two.__dict__, "share": 0.2}))


def test_extend_equals_rebuild(spark):
    rng = random.Random(9)
    rows = baskets(8, 50)
    values = numbers(rng, rows)
    for item in (3,):
        old = lattice_of(spark, [[i for i in r if i != item] for r in rows], [[v for k, v in enumerate(x)] for x in values])
        old = maintained.Lattice(**{**old.__dict__, "values": old.values.where(F.col("feature") != item)})
        new = maintained.extend(old, table(spark, rows).where(F.col("item") == item), spark.createDataFrame([(t, item, x[item]) for t, x in enumerate(values)], "tid long, feature int, x double"))
        assert state(new) == state(lattice_of(spark, rows, values))
    rare = maintained.extend(old, spark.createDataFrame([(0, 77)], "tid long, item int"), old.values.limit(0))
    assert state(rare) == state(old) and got(rare.low)[(77,)] == 1
    with pytest.raises(ValueError):
        maintained.extend(old, table(spark, rows).where("item < 2"), old.values.limit(0))


def test_rows_go_to_their_largest_node(spark):
    rows = [[1, 2, 3], [1, 2, 9], [9], [3, 9]]
    nodes = spark.createDataFrame([([1],), ([1, 2],), ([2, 3],), ([3],)], "items array<int>")
    found = lattice.assign_rows(table(spark, rows), nodes, 1)
    assert {r["tid"]: (r["level"], tuple(r["items"])) for r in found.collect()} == {0: (1, (1, 2)), 1: (1, (1, 2)), 3: (1, (3,))}


def test_rows_meet_their_largest_node_without_a_join(spark, monkeypatch):
    """Over several chunks and parts; a join would broadcast the rows that an Arrow function returns, as Spark takes them for few."""
    monkeypatch.setattr(bitmaps, "CHUNK", 20)
    monkeypatch.setattr(bitmaps, "PART", 3)
    r = random.Random(3)
    rows = [[k for k in range(6) if r.random() < 0.6] or [9] for _ in range(90)]
    nodes = [[0], [1], [0, 1], [2, 3], [1, 2], [3, 4, 5], [0, 4, 5], [2, 5], [5]]
    found = lattice.assign_rows(table(spark, rows), spark.createDataFrame([(n,) for n in nodes], "items array<int>"), 3)
    want = {}
    for t, held in enumerate(rows):
        inside = [(len(held) - len(n), n) for n in nodes if set(n) <= set(held) and len(held) - len(n) <= 3]
        if inside:
            want[t] = min(inside)
    got = [(x["tid"], (x["level"], x["items"])) for x in found.collect()]
    assert len(got) == len(want) and dict(got) == want
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rounds_of_nearest_pairs_end_where_single_merges_do(spark):
    """Twelve clusters in three far groups with ties inside them; one cluster is tiny."""
    rows = []
    for k in range(12):
        x, y = (k % 3) * 1000.0 + (k // 3) * 2.0, (k // 6) * 1.0
        rows += [(k, [x + d, y]) for d in (-0.25, 0.25)] * (1 if k == 5 else 4)
    table = spark.createDataFrame(rows, "cluster int, x array<double>")
    summary = lattice.summaries(table, "cluster", "x")
    groups = [{k for k in range(12) if k % 3 == g} for g in range(3)]
    for most in (12, 5, 3):
        got = {}
        for r in lattice.hierarchical_merge(summary, 3, small=0.03, most=most).collect():
            got.setdefault(r["final"], set()).add(r["cluster"])
        assert sorted(got.values(), key=min) == groups and sorted(got) == [0, 1, 2], most
    alone = lattice.hierarchical_merge(summary, 20, small=0.0, most=5)
    assert all(r["cluster"] == r["final"] for r in alone.collect()) and alone.count() == 12
    merged = lattice._added_up(summary, lattice._merged_pairs(summary, 1))
    assert merged.agg(F.sum("n")).first()[0] == len(rows) and merged.count() < 12


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """A task's share of lines and pairs is bounded: more rows are more parts, whatever spark.sql.shuffle.partitions says."""
    monkeypatch.setattr(itemsets, "ROWS", 50)
    rows = spark.range(400).select(F.col("id").alias("tid"), F.explode(F.array(*(F.pmod(F.col("id") * k + k * k, F.lit(1500)) for k in range(1, 5)))).alias("item"))
    rows = rows.unionByName(rows.limit(7)).unionByName(spark.createDataFrame([(None, 1), (None, 2), (5, None)], "tid long, item long"))
    once = {(r["tid"], r["item"]) for r in rows.collect() if r["item"] is not None}
    by_tid, plain = {}, {}
    for t, i in once:
        if t is not None:
            by_tid.setdefault(t, set()).add(i)
    for held in by_tid.values():
        for x in held:
            for y in held:
                if x < y:
                    plain[x, y] = plain.get((x, y), 0) + 1
    lists, counts = itemsets._pairs(rows.where("item is not null").distinct())
    assert counts.rdd.getNumPartitions() == itemsets._parts(sum(plain.values())) > 20
    assert {tuple(r["items"]): r["support"] for r in counts.collect()} == plain
    assert lists.count() == sum(plain.values())
    found = {tuple(r["items"]): r["support"] for r in itemsets.frequent_itemsets(rows, 1, 2).where(F.size("items") == 2).collect()}
    assert found == plain
