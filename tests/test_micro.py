"""Hand-made fixtures for ties, ends and undefined values."""

import pytest
from pyspark.sql import functions as F
from strandline.functions import maps, text, vec
from strandline.operators import itemsets, labelling, lattice, sampling, sequence, spatial, stats
from strandline.sources import catalog, logs, trajectories


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, k, v) for k, v in enumerate(values)], "key string, i long, v double")


def states(spark, values):
    return spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "key string, i long, s int")


@pytest.mark.parametrize(("method", "left"), [("median", 5), ("mean", 5), ("middle", 6), ("max_gap", 6)])
def test_ties_go_left(spark, method, left):
    points = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 2, 2, 3, 10)], "x double")
    found, splits = spatial.kd_tree(points, ["x"], method, 1)
    assert found.where("path = '0'").count() == left
    assert spatial.kd_probe(points, splits, ["x"], 1).where("path = '0'").count() == left


def test_tree_is_a_partition(spark):
    points = spark.createDataFrame([(k, float(k * 37 % 101), float(k * 53 % 97)) for k in range(200)], "id long, x double, y double")
    found, splits = spatial.kd_tree(points, ["x", "y"], "median", 5, 10)
    assert found.select("id").distinct().count() == found.count() == 200
    again = spatial.kd_probe(points, splits, ["x", "y"], 5).select("id", F.col("path").alias("again"))
    assert found.join(again, "id").where("path <> again").count() == 0


@pytest.mark.parametrize(
    ("values", "ten", "pair"),
    [([0, 0, 1, 1], "T1", (1, 0)), ([0] * 9 + [1], "T0", (0, 1)), ([0] * 10, "W0", (0, 0)), ([2, 2, 3, 3, 2], "T2", (2, 3)), ([4, 4, 4, 4, 4, 4, 4, 1], "T4", (4, 1))],
)
def test_segment_labels(spark, values, ten, pair):
    rows = states(spark, values)
    assert sequence.segment_label10(rows, ["key"], "i", "s").first()["label"] == ten
    got = sequence.segment_label25(rows, ["key"], "i", "s").first()
    assert (got["state_a"], got["state_b"]) == pair


@pytest.mark.parametrize(("n", "blocks"), [(13, 4), (12, 3), (3, 0), (6, 1), (7, 2)])
def test_block_ends_strictly(spark, n, blocks):
    got = stats.bootstrap_block(series(spark, [float(k) for k in range(n)]), ["key"], "i", "v", 3).first()
    assert got["blocks"] == blocks
    assert (got["ci"] == 1.0) == (blocks < 2)


def test_intervals_of_short_and_constant_series(spark):
    one = stats.bootstrap_std(series(spark, [4.0]), "v", "key").first()
    assert (one["ci"], one["sigma"]) == (0.0, 0.0)
    zero = stats.bootstrap_std(series(spark, [0.0, 0.0]), "v", "key").first()
    assert zero["rel"] is None
    got = stats.convergence_series(series(spark, [0.0, 2.0]), ["key"], "i", "v").orderBy("k").collect()
    assert [r["conv"] for r in got] == [1.0, 1.0]


def test_histogram_edges(spark):
    got = stats.histogram(series(spark, [3.99, 4.0, 7.99, 8.0, 8.01]), "v", 4.0, 8.0, 20).collect()
    assert {r["bin"]: r["n"] for r in got} == {0: 1, 19: 2}


def test_itemset_supports_and_lattice(spark):
    baskets = [("t1", "abc"), ("t2", "abc"), ("t3", "ab"), ("t4", "bc"), ("t5", "d")]
    rows = spark.createDataFrame([(t, c) for t, items in baskets for c in items], "tid string, item string")
    found = {"".join(r["items"]): r["support"] for r in itemsets.frequent_itemsets(rows, 2, 3).collect()}
    assert found == {"a": 3, "b": 4, "c": 3, "ab": 3, "ac": 2, "bc": 3, "abc": 2}
    top = itemsets.maximal(itemsets.frequent_itemsets(rows, 2, 3))
    assert ["".join(r["items"]) for r in top.collect()] == ["abc"]
    nodes = itemsets.lattice_nodes(top)
    assert nodes.count() == 7
    edges = itemsets.lattice_edges(nodes)
    assert edges.count() == 9
    lists = itemsets.members(nodes, rows)
    full = {("".join(r["items"]), r["tid"]) for r in lists.collect()}
    back = itemsets.decompress(itemsets.compress(lists, edges), edges, 3)
    assert {("".join(r["items"]), r["tid"]) for r in back.collect()} == full


def test_flow_is_the_loop_of_prefix_sums(spark):
    child, parent = [1, 2, 3, 0, 4], [2, 0, 3, 4, 1]
    flow, run = 0.0, 0.0
    for c, p in zip(child[:-1], parent[:-1]):
        run += c / 10 - p / 10
        flow += run
    rows = [(("x",), "f", float(k)) for k, n in enumerate(child) for _ in range(n)] + [(("x", "y"), "f", float(k)) for k, n in enumerate(parent) for _ in range(n)]
    means = spark.createDataFrame([(list(i), "x", v) for i, _, v in rows], "items array<string>, feature string, v double").groupBy("items", "feature").agg(F.avg("v").alias("mean_bin"))
    edges = spark.createDataFrame([(["x"], ["x", "y"])], "child array<string>, parent array<string>")
    assert itemsets.edge_weights(edges, means, 5).first()["emd"] == pytest.approx(abs(flow) / 4)


def test_centred_window_and_deltas(spark):
    rows = series(spark, [float(k) for k in range(8)])
    got = [r["smooth"] for r in sequence.noise_filter(rows, ["key"], "i", "v", 2).orderBy("i").collect()]
    assert got == [sum(x) / len(x) for x in ([v for v in range(8) if i - 2 <= v <= i + 1] for i in range(8))]
    assert [r["delta"] for r in sequence.centred_delta(rows, ["key"], "i", "v").orderBy("i").collect()] == [0.0] + [2.0] * 6 + [0.0]


def test_equal_distances_take_the_lower_state(spark):
    frames = spark.createDataFrame([([0.0, 0.0],)], "x array<double>")
    cents = spark.createDataFrame([(2, [1.0, 0.0]), (1, [0.0, 1.0]), (0, [3.0, 0.0])], "state int, c array<double>")
    near = labelling.with_distances(frames, cents, "x").first()["near"]
    assert [e["state"] for e in near] == [1, 2, 0]


def test_intervals_are_half_open(spark):
    points = spark.createDataFrame([(k,) for k in range(10)], "at long")
    jobs = spark.createDataFrame([("a", 0, 5), ("b", 5, 9), ("none", 3, 3)], "job string, s long, e long")
    got = sequence.interval_join(points, "at", jobs, "s", "e", 4).groupBy("job").agg(F.count("*").alias("n"))
    assert {r["job"]: r["n"] for r in got.collect()} == {"a": 5, "b": 4}


def test_gaps(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 29 * 60), ("a", 60 * 60)], "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    got = sequence.compress_gaps(rows, ["key"], "ts").agg(F.max("busy")).first()[0]
    assert got == 29 * 60


def test_samples_merge(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    whole = {(r["k"], r["id"]) for r in sampling.bottom_k(rows, ["k"], "id", 10).collect()}
    parts = sampling.bottom_k(rows.where("id < 200"), ["k"], "id", 10).unionByName(sampling.bottom_k(rows.where("id >= 200"), ["k"], "id", 10)).drop("h")
    assert {(r["k"], r["id"]) for r in sampling.bottom_k(parts, ["k"], "id", 10).collect()} == whole


def test_pdfs_sum_to_one(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 0), ("c", 3)], "bin string, n long")
    got = {r["bin"]: r["p"] for r in sampling.umbrella_pdf(counts).collect()}
    assert sum(got.values()) == pytest.approx(1.0) and got["b"] == 0.0 and got["c"] > got["a"]
    assert sampling.weighted_draws(sampling.umbrella_pdf(counts), "bin", "p", 50).count() == 50


def test_merge_of_summaries(spark):
    rows = spark.createDataFrame([(k // 3, [float(k // 6), 0.1 * (k % 3)]) for k in range(12)], "c int, x array<double>")
    summary = lattice.summaries(rows, "c", "x")
    mapping = {r["cluster"]: r["final"] for r in lattice.hierarchical_merge(summary, 2).collect()}
    assert mapping == {0: 0, 1: 0, 2: 2, 3: 2}


def test_logs(spark):
    lines = spark.createDataFrame([("f", x) for x in ("Output a b c d e 40", "Output a b c d e 7", "noise", "+++ 3 1 5", "--- 9 1 5", "... 1 2 3", "1.5 2", "c1,3,1.5,2.5,lab", "BASIN,b1,A,B,010")], "file string, line string")
    assert sorted(r["bound"] for r in logs.segment_bounds(lines).collect()) == [0, 7, 40]
    assert [(r["kind"], r["step"], r["r1"], r["r2"]) for r in logs.contact_events(lines).orderBy("step").collect()] == [("+++", 3, 0, 4), ("---", 9, 0, 4)]
    assert logs.benchmark_lines(lines).count() == logs.outcome_lines(lines).count() == 1
    assert logs.label_lines(lines).first()["state"] == 2


def test_text(spark):
    row = spark.range(1).select(
        text.duration_seconds(F.lit("1-02:03:04")).alias("a"), text.duration_seconds(F.lit("02:03")).alias("b"), text.duration_seconds(F.lit("x")).alias("c"), text.job_number(F.lit("job-12.7")).alias("d"), text.strip_braces(F.lit("[(1, 2)]")).alias("e")
    ).first()
    assert tuple(row) == (93784, 123, None, 1207, "1 2")


def test_vectors(spark):
    row = spark.createDataFrame([([0.0, 0.0, 0.0, 3.0, 4.0, 0.0],)], "x array<double>").select(vec.pair_distances(F.col("x")).alias("d"), vec.gather(F.col("x"), F.array(F.lit(4), F.lit(3))).alias("g")).first()
    assert row["d"] == [5.0] and row["g"] == [4.0, 3.0]


def test_catalog(spark, tmp_path):
    store = catalog.Catalog(spark, f"file://{tmp_path}")
    store.save("c", spark.createDataFrame([("a", 1)], "key string, v long"))
    store.append("c", spark.createDataFrame([("a", 2), ("b", 5)], "key string, v long"))
    assert {r["key"]: r["v"] for r in store.counters("c").collect()} == {"a": 3, "b": 5}


def grid_points(spark, ids):
    return spark.createDataFrame([(k, float(k * 37 % 101), float(k * 53 % 97)) for k in ids], "id long, x double, y double")


@pytest.mark.parametrize("method", ["median", "mean", "middle", "max_gap"])
def test_batches_into_a_tree(spark, method):
    """After two batches no leaf is over its size, every point lies where the splits lead it, and untouched leaves are as they were."""
    tree, splits = spatial.kd_tree(grid_points(spark, range(60)), ["x", "y"], method, 3, 10)
    before = {r["path"] for r in tree.select("path").distinct().collect()}
    for ids in (range(60, 75), range(75, 200)):
        tree, splits = spatial.kd_insert(tree, splits, grid_points(spark, ids), ["x", "y"], method, 20, 10)
    sizes = {r["path"]: r["count"] for r in tree.groupBy("path").count().collect()}
    assert sum(sizes.values()) == 200 and max(sizes.values()) <= 10
    assert not any(a != b and b.startswith(a) for a in sizes for b in sizes)
    assert all(any(p.startswith(b) for b in before) or any(b.startswith(p) for b in before) for p in sizes)
    again = spatial.kd_probe(grid_points(spark, range(200)), splits, ["x", "y"], 20).select("id", F.col("path").alias("again"))
    assert tree.join(again, "id").where("path <> again").count() == 0
    assert splits.groupBy("path").count().where("count > 1").count() == 0


def test_equal_points_end_the_splitting(spark):
    same = spark.createDataFrame([(k, 1.0, 2.0) for k in range(9)] + [(9, 1.0, 3.0)], "id long, x double, y double")
    tree, splits = spatial.kd_tree(same.limit(0), ["x", "y"], "middle", 2, 3)
    tree, splits = spatial.kd_insert(tree, splits, same, ["x", "y"], "middle", 12, 3)
    assert sorted(r["count"] for r in tree.groupBy("path").count().collect()) == [1, 9] and splits.count() == 2


def test_sparse_tree_shares_its_first_planes(spark):
    points = grid_points(spark, range(50))
    tree, splits = spatial.sparse_kd_tree(points, ["x", "y"], "middle", 5)
    whole = {r["axis"]: r["mid"] for r in splits.where(F.length("path") < 2).collect()}
    assert whole == {c: (points.agg(F.min(c)).first()[0] + points.agg(F.max(c)).first()[0]) / 2 for c in "xy"}
    assert {len(r["path"]) for r in tree.collect()} == {5}
    more = spatial.sparse_kd_insert(tree, splits, grid_points(spark, range(50, 90)), ["x", "y"], 5)
    assert more.count() == 90 and {len(r["path"]) for r in more.collect()} == {5}
    wrong = more.where((F.substring("path", 1, 1) == "1") != (F.col("x") > whole["x"])).count() + more.where((F.substring("path", 2, 1) == "1") != (F.col("y") > whole["y"])).count()
    assert wrong == 0


def plain_windows(values, theta):
    """(start, end) by the distances of each frame to all frames of its window."""
    start, out = 0, []
    for t in range(2, len(values)):
        score = sum(abs(values[i] - values[t]) for i in range(start, t - 2)) - sum(abs(values[i] - values[t - 2]) for i in range(start, t - 2))
        if score > theta:
            out.append((start, t - 1))
            start = t
    return [*out, (start, len(values) - 1)]


@pytest.mark.parametrize("theta", [3.0, 12.0, 1000.0])
def test_pairwise_segments_equal_plain(spark, theta):
    data = {k: [float((i * i * (3 + k)) % 17 + (i // 20) * 5) for i in range(90)] for k in range(3)}
    rows = spark.createDataFrame([(k, i, [v, v]) for k, values in data.items() for i, v in enumerate(values)], "key int, i int, x array<double>")
    got = {}
    for r in sequence.pairwise_segments(rows, ["key"], "i", "x", theta).orderBy("key", "seg").collect():
        got.setdefault(r["key"], []).append((r["start"], r["end"]))
        assert r["length"] == r["end"] - r["start"] + 1
    assert got == {k: plain_windows(v, theta) for k, v in data.items()}


def test_maps(spark):
    rows = spark.createDataFrame([(["b", "a", "b", "c", "c"], {"b": 1, "z": 5}), ([], None)], "k array<string>, m map<string,long>")
    out = rows.select(maps.tally(F.col("k")).alias("t"), maps.merge(maps.tally(F.col("k")), F.col("m")).alias("u"), maps.top_key(maps.tally(F.col("k"))).alias("top"), maps.lookup(F.col("m"), F.lit("q"), F.lit(7)).alias("q")).collect()
    assert out[0]["t"] == {"a": 1, "b": 2, "c": 2} and out[0]["u"] == {"a": 1, "b": 3, "c": 2, "z": 5} and out[0]["top"] == "b" and out[0]["q"] == 7
    assert out[1]["t"] == {} == out[1]["u"] and out[1]["top"] is None


def test_packed_arrays(spark):
    a = catalog.packed(F.col("v"), 2, 3)
    row = spark.createDataFrame([([1, 2, 3, 4, 5, 6],)], "v array<int>").withColumn("a", a).select("a", catalog.cell(F.col("a"), 1, 2).alias("x"), catalog.cell(F.col("a"), 2, 0).alias("y"), catalog.cell(F.col("a"), 0).alias("z")).first()
    assert list(row["a"]["shape"]) == [2, 3] and (row["x"], row["y"], row["z"]) == (6, None, None)
    assert spark.createDataFrame([([1, 2],)], "v array<int>").select(a.alias("a")).first()["a"] is None


def test_many_queries_are_dealt_to_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(k * 37 % 101), float(k * 53 % 97)]) for k in range(60)], "id long, x array<double>")
    whole = sorted(map(tuple, spatial.nearest_rows(rows, rows, "id", "x", 2).collect()))
    monkeypatch.setattr(spatial, "QUERY_BYTES", 1000)
    assert sorted(map(tuple, spatial.nearest_rows(rows, rows, "id", "x", 2).collect())) == whole and len(whole) == 120


def test_key_values_and_jobs(spark):
    lines = spark.createDataFrame([("f", 1, "job: 7"), ("f", 3, "state: done"), ("f", 2, "state: run"), ("g", 1, "job: x"), ("g", 2, ": none"), ("g", 3, "a:b:c")], "file string, n int, line string")
    got = {r["file"]: r for r in logs.job_rows(lines, "n", "job", spark.createDataFrame([(7, 1.5)], "job long, cpu double")).collect()}
    assert got["f"]["values"] == {"job": "7", "state": "done"} and got["f"]["cpu"] == 1.5
    assert got["g"]["values"] == {"job": "x", "a": "b:c"} and got["g"]["cpu"] is None


def test_side_chains(spark):
    atoms = spark.createDataFrame([(1, "ALA", "N", 1), (1, "ALA", "CA", 2), (2, "SER", "CA", 3), (2, "SER", "CB", 4), (3, "HOH", "O", 5), (4, "TYR", "CZ", 6)] * 2, "resid int, residue string, name string, serial long")
    assert sorted(map(tuple, trajectories.side_chain_pairs(atoms).collect())) == [(2, 4), (2, 6), (4, 6)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_cover_pairs_equals_greedy(spark, seed):
    data = sorted({(i * (7 + seed) % 13, (i * i + seed) % 17 + 13) for i in range(40)})
    degree = {}
    for p in data:
        for r in p:
            degree[r] = degree.get(r, 0) + 1
    picked, seen = set(), set()
    for p in sorted(data, key=lambda p: (degree[p[0]] + degree[p[1]], p)):
        if not set(p) <= seen:
            picked.add(p)
            seen |= set(p)
    assert set(map(tuple, itemsets.cover_pairs(spark.createDataFrame(data * 2, "x int, y int"), "x", "y").collect())) == picked


def test_eliminated_features_equal_plain(spark):
    n, theta = 40, 0.2
    columns = {0: {k for k in range(40) if k % 2}, 1: {k for k in range(40) if k % 2 or k == 0}, 2: {k for k in range(40) if not k % 2}, 3: set(range(5)), 4: {k for k in range(40) if k % 3}, 5: set(range(18)), 6: set(range(18, 40))}
    ones = {c: s for c, s in columns.items() if len(s) >= theta * n}
    agree = {(a, b): sum((k in ones[a]) == (k in ones[b]) for k in range(n)) for a in ones for b in ones if a < b}
    gone = {c for p, x in agree.items() if x < theta * n or x > n - theta * n for c in p}
    rows = spark.createDataFrame([(k, c) for c, s in columns.items() for k in s], "tid int, item int")
    got = {r["item"]: r["ones"] for r in itemsets.eliminate_features(rows, n, theta).collect()}
    assert got == {c: len(s) for c, s in ones.items() if c not in gone} == {4: 26}


def test_contact_counts_sum_the_matrix(spark):
    told = spark.createDataFrame([("a", 2, "+++"), ("a", 5, "---"), ("b", 3, "---"), ("b", 5, "+++"), ("c", 5, "+++"), ("c", 6, "+++")], "key string, step int, kind string")
    frames = spark.createDataFrame([(k,) for k in (0, 2, 4, 5, 9, 9)], "step int")
    wide = sequence.contact_matrix(told, ["key"], "step", "kind", frames).groupBy("step").agg(F.sum("on").alias("contacts"), F.count("*").alias("pairs"))
    want = {(r["step"], r["contacts"], r["pairs"]) for r in wide.collect()}
    assert {tuple(r) for r in sequence.contact_counts(told, ["key"], "step", "kind", frames).collect()} == want == {(0, 0, 3), (2, 1, 3), (4, 1, 3), (5, 2, 3), (9, 2, 3)}


def test_log_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("Output of run begins at step 42\n+++ 7 3 9\n--- 8 3 9\n+++ x 1 2\n0.5 3\nrun,4,1.5,0.25,test\nrun,x,1,1,t\nBASIN,b1,t2,a3,l4\n")
    at = f"{tmp_path}/a.log"
    assert {r["bound"] for r in logs.read_segment_bounds(spark, at).collect()} == {0, 42}
    assert [(r["kind"], r["step"], r["r1"], r["r2"]) for r in logs.read_contact_events(spark, at).collect()] == [("+++", 7, 2, 8), ("---", 8, 2, 8)]
    assert [(r["time"], r["state"]) for r in logs.read_labels(spark, at).collect()] == [(0.5, 3)]
    assert [(r["ctlid"], r["num"], r["runtime"], r["label"]) for r in logs.read_benchmarks(spark, at).collect()] == [("run", 4, 1.5, "test")]
    assert [(r["bid"], r["target"], r["actual"], r["labels"]) for r in logs.read_outcomes(spark, at).collect()] == [("b1", "t2", "a3", "l4")]


def test_landscapes_evaluate_their_distances_once(spark):
    row = spark.createDataFrame([(1, [4.0, 1.0, 3.0, 1.5, 9.0])], "id long, d array<double>")
    d = F.array_sort("d")
    wins = labelling.landscape_states(F.slice(labelling.landscape(d), 11, 10))
    for column in (wins, labelling.landscape(d), labelling.landscape_frames(d)):
        plan = row.select(column.alias("f"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("array_sort(") <= 1
    unsorted = labelling.landscape_states(F.slice(labelling.landscape(F.col("d")), 11, 10))
    found = row.select(labelling.landscape(F.col("d")).alias("f"), unsorted.alias("w")).first()
    assert found["f"][:10] == [0.0, 10.0, 0.0, 0.0, 0.0, 6.0, 9.0, 7.0, 8.5, 1.0]
    assert found["w"] == [False, True, False, False, False]
