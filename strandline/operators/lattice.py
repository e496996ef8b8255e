"""Clusters from a weighted lattice: collapse, assignment of rows, hierarchical merge of summaries, and scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..lineage import cut
from .itemsets import largest_members
from .spatial import nearest_rows


def collapse(edges: DataFrame, nodes: DataFrame, theta: float, longest: int) -> DataFrame:
    """(root, items, weight): every node under the roots it merges into.

    A child merges into each parent with similarity 1 - emd of at least theta; weights multiply
    along the way, and the best way counts. A node without such a parent is a root.
    """
    close = edges.withColumn("sim", 1 - F.col("emd")).where((F.col("sim") >= theta) & (F.col("emd") < 1)).select("child", "parent", "sim")
    level = nodes.select("items").join(close.select(F.col("child").alias("items")).distinct(), "items", "left_anti").select(F.col("items").alias("root"), "items", F.lit(1.0).alias("weight"))
    found = level
    for _ in range(longest - 1):
        level = level.withColumnRenamed("items", "parent").join(close, "parent").groupBy("root", F.col("child").alias("items")).agg(F.max(F.col("weight") * F.col("sim")).alias("weight"))
        found = found.unionByName(level)
    return found.groupBy("root", "items").agg(F.max("weight").alias("weight"))


def best_parent(edges: DataFrame) -> DataFrame:
    """Each child's parent of the least emd, the lower parent first among equals: (child, parent, emd)."""
    return edges.groupBy("child").agg(F.min_by("parent", F.struct("emd", "parent")).alias("parent"), F.min("emd").alias("emd"))


def groups_by_best_parent(edges: DataFrame, nodes: DataFrame, theta: float, longest: int) -> DataFrame:
    """(items, root): nodes follow their best parent upwards while its emd is at most theta."""
    up = best_parent(edges.where(F.col("emd") <= theta)).select(F.col("child").alias("root"), F.col("parent").alias("above"))
    now = nodes.select("items", F.col("items").alias("root"))
    for _ in range(longest - 1):
        now = now.join(up, "root", "left").select("items", F.coalesce("above", "root").alias("root"))
    return now


def assign_rows(transactions: DataFrame, groups: DataFrame, most: int = 4) -> DataFrame:
    """(tid, level, items): each row's own pattern if it is a node, else the largest subset that is one.

    Level is the number of dropped items, at most min(most, items - 1) of them; the lower set first among equals. Rows
    without a match are left out. Rows meet the nodes by item, so no subsets are made.
    """
    patterns = transactions.where("tid is not null").select("tid", "item").distinct().groupBy("tid").agg(F.count("*").cast("int").alias("size"))
    held = largest_members(groups.select("items").distinct(), transactions).where("tid is not null").select("tid", F.struct((-F.size("items")).alias("less"), "items").alias("m"))
    # One aggregate, not a join: Spark takes the rows that Arrow functions return for fewer than they are, and would broadcast them.
    both = held.unionByName(patterns, allowMissingColumns=True).groupBy("tid").agg(F.min("m").alias("m"), F.max("size").alias("size"))
    return both.where("m is not null").select("tid", (F.col("size") + F.col("m.less")).alias("level"), "m.items").where(F.col("level") <= most)


def summaries(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, n, s, q): size, sums and summed squares by dimension, which add up when clusters merge."""
    parts = rows.select(cluster, F.posexplode(vector).alias("i", "x")).groupBy(cluster, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    cells = F.array_sort(F.collect_list(F.struct("i", "s", "q")))
    return parts.groupBy(F.col(cluster).alias("cluster")).agg(F.max("n").alias("n"), F.transform(cells, lambda c: c["s"]).alias("s"), F.transform(cells, lambda c: c["q"]).alias("q"))


#: Clusters that are merged pair by pair on the driver.
MAX_SUMMARIES = 5_000


def _merged_pairs(summary: DataFrame, target: int) -> DataFrame:
    """(keep, gone): clusters that are each other's nearest by their centroids, the closest first, as many as leave ``target`` clusters at least."""
    centres = summary.select("cluster", F.transform("s", lambda x: x / F.col("n")).alias("centroid"))
    near = cut(nearest_rows(centres, centres, "cluster", "centroid", 1).select("query", F.col("cluster").alias("nearest"), "d"))
    back = near.select(F.col("nearest").alias("query"), F.col("query").alias("nearest"))
    pairs = near.join(back, ["query", "nearest"]).where("query < nearest").select(F.col("query").alias("keep"), F.col("nearest").alias("gone"), "d")
    return cut(pairs.orderBy("d", "keep").limit(max(0, summary.count() - target)).drop("d"))


def _added_up(summary: DataFrame, step: DataFrame) -> DataFrame:
    """Summaries after the merges (keep, gone) of a step."""
    moved = summary.join(step.withColumnRenamed("gone", "cluster"), "cluster", "left").withColumn("cluster", F.coalesce("keep", "cluster"))
    cells = moved.select("cluster", "n", F.posexplode(F.arrays_zip("s", "q")).alias("i", "c")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("c.s").alias("s"), F.sum("c.q").alias("q"))
    both = F.array_sort(F.collect_list(F.struct("i", "s", "q")))
    return cut(cells.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(both, lambda c: c["s"]).alias("s"), F.transform(both, lambda c: c["q"]).alias("q")))


def hierarchical_merge(summary: DataFrame, target: int, small: float = 0.0001, most: int = MAX_SUMMARIES) -> DataFrame:
    """(cluster, final): merges the pair of clusters with the closest centroids until ``target`` are left.

    While there are more than ``most`` clusters, those that are each other's nearest are merged, all
    in one round; the global closest pair is always among them. The rest is merged pair by pair on
    the driver, from the summaries of at most ``most`` clusters. There, clusters under ``small`` of
    all rows go first, each into its nearest neighbour. Ties go to the lower clusters.
    """
    now, before = summary, summary.select("cluster", F.col("cluster").alias("final"))
    while now.count() > max(most, target):
        step = _merged_pairs(now, target)
        now = _added_up(now, step)
        before = cut(before.join(step.withColumnRenamed("gone", "final"), "final", "left").select("cluster", F.coalesce("keep", "final").alias("final")))
    last = _merged_one_by_one(now, target, small)
    return before.withColumnRenamed("final", "between").join(last.withColumnRenamed("cluster", "between"), "between").select("cluster", "final")


def _merged_one_by_one(summary: DataFrame, target: int, small: float) -> DataFrame:
    held = summary.select("cluster", "n", "s").orderBy("cluster").collect()
    live = {k: (r["n"], list(r["s"])) for k, r in enumerate(held)}
    final = {k: k for k in live}
    total = sum(n for n, _ in live.values())
    centre = {k: [x / n for x in s] for k, (n, s) in live.items()}
    near: dict[int, tuple[float, int]] = {}

    def seek(k: int) -> None:
        near[k] = min(((math.dist(centre[k], centre[j]), j) for j in live if j != k), default=(math.inf, -1))

    for k in live:
        seek(k)
    while len(live) > max(1, target) or any(n < small * total for n, _ in live.values()):
        if len(live) == 1:
            break
        tiny = [k for k, (n, _) in live.items() if n < small * total]
        a = min(tiny, key=lambda k: (live[k][0], k)) if tiny else min(live, key=lambda k: (near[k], k))
        b = near[a][1]
        keep, gone = min(a, b), max(a, b)
        n = live[keep][0] + live[gone][0]
        live[keep] = (n, [x + y for x, y in zip(live[keep][1], live[gone][1])])
        centre[keep] = [x / n for x in live[keep][1]]
        del live[gone], centre[gone], near[gone]
        final = {k: keep if f == gone else f for k, f in final.items()}
        for k in live:
            if k == keep or near[k][1] in (keep, gone):
                seek(k)
            elif (d := math.dist(centre[k], centre[keep])) < near[k][0]:
                near[k] = (d, keep)
    rows = [(held[k]["cluster"], held[f]["cluster"]) for k, f in final.items()]
    kind = summary.schema["cluster"].dataType.simpleString()
    return summary.sparkSession.createDataFrame(rows, f"cluster {kind}, final {kind}")


def merged_summaries(summary: DataFrame, mapping: DataFrame) -> DataFrame:
    """Summaries of the final clusters, with centroid and variance (the summed sample variances of the dimensions)."""
    parts = summary.join(mapping, "cluster").select("final", "n", F.posexplode(F.arrays_zip("s", "q")).alias("i", "c"))
    sums = parts.groupBy("final", "i").agg(F.sum("n").alias("n"), F.sum("c.s").alias("s"), F.sum("c.q").alias("q"))
    variance = F.when(F.col("n") > 1, (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).otherwise(0.0)
    cells = F.array_sort(F.collect_list(F.struct("i", (F.col("s") / F.col("n")).alias("m"))))
    return sums.groupBy("final").agg(F.max("n").alias("n"), F.transform(cells, lambda c: c["m"]).alias("centroid"), F.sum(variance).alias("variance"))


def cluster_scores(clusters: DataFrame, clusters_wanted: int) -> DataFrame:
    """Adds score: low_var / variance + 1 - 2 C n / N, less 1 for clusters under .00025 N, at least 0."""
    w = Window.partitionBy()
    total, low = F.sum("n").over(w), F.min(F.when(F.col("variance") > 0, F.col("variance"))).over(w)
    share = F.col("n") / total
    score = F.coalesce(F.try_divide(low, F.col("variance")), F.lit(0.0)) + 1 - 2 * clusters_wanted * share - F.when(share < 0.00025, 1.0).otherwise(0.0)
    return clusters.withColumn("score", F.greatest(score, F.lit(0.0)))


def ranked_members(rows: DataFrame, cluster: str, name: str, vector: str, centres: DataFrame) -> DataFrame:
    """Adds d (distance to the cluster's centroid) and rank in the cluster, nearest first."""
    d = vec.distance(F.col(vector), F.col("centroid"))
    out = rows.join(centres.select(F.col("final").alias(cluster), "centroid"), cluster).withColumn("d", d).drop("centroid")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(cluster).orderBy("d", name)))


def cuboid_scores(members: DataFrame, cluster: str) -> DataFrame:
    """Per cluster: n, mean and total distance to the centroid, from rows with d."""
    return members.groupBy(cluster).agg(F.count("*").alias("n"), F.avg("d").alias("mean_d"), F.sum("d").alias("total_d"))


def well_transition_scores(clusters: DataFrame, centre: str = "centroid") -> DataFrame:
    """Adds well, transition and crowd (other centroids nearer than mean - deviation of all centroid distances).

    well grows with size and falls with variance; transition is its complement, damped by crowding.
    """
    a, b = clusters.alias("a"), clusters.alias("b")
    pairs = a.join(b, F.expr("a.final <> b.final")).select(F.col("a.final").alias("final"), vec.distance(F.col(f"a.{centre}"), F.col(f"b.{centre}")).alias("d"))
    limits = pairs.agg((F.avg("d") - F.stddev_pop("d")).alias("near"))
    crowd = pairs.crossJoin(F.broadcast(limits)).groupBy("final").agg(F.count_if(F.col("d") < F.col("near")).alias("crowd"))
    w = Window.partitionBy()
    size = vec.logistic(F.col("n") / F.avg("n").over(w), 1.0, 3.0, 1.0)
    tight = 1 - F.try_divide(F.col("variance"), F.max("variance").over(w))
    out = clusters.join(crowd, "final", "left").withColumn("crowd", F.coalesce("crowd", F.lit(0)))
    return out.withColumn("well", size * F.coalesce(tight, F.lit(0.0))).withColumn("transition", (1 - F.col("well")) / (1 + F.col("crowd")))


def label_scores(members: DataFrame, cluster: str, label: str, scores: DataFrame) -> DataFrame:
    """Score of each label: its clusters' scores, weighted by the label's share in each cluster."""
    counts = members.groupBy(cluster, label).agg(F.count("*").alias("c"))
    shares = counts.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy(cluster)))
    return shares.join(scores.select(F.col("final").alias(cluster), "score"), cluster).groupBy(label).agg(F.sum(F.col("share") * F.col("score")).alias("score"))


def paths(edges: DataFrame, roots: DataFrame, longest: int) -> DataFrame:
    """All downward paths from roots: (root, node, path), a path being an array of nodes."""
    level = roots.select(F.col("items").alias("root"), F.col("items").alias("node"), F.array("items").alias("path"))
    found = level
    for _ in range(longest - 1):
        level = level.join(edges.select(F.col("parent").alias("node"), "child"), "node").select("root", F.col("child").alias("node"), F.concat("path", F.array("child")).alias("path"))
        found = found.unionByName(level)
    return found


def traces(edges: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """(items, trace): each node and, one after the other, the best parents above it up to a root, for lattices of ``levels`` sizes."""
    up = best_parent(edges).select(F.col("child").alias("top"), "parent")
    now = nodes.select("items", F.col("items").alias("top"), F.array("items").alias("trace"))
    for _ in range(levels - 1):
        now = now.join(up, "top", "left").select("items", F.coalesce("parent", "top").alias("top"), F.when(F.col("parent").isNull(), F.col("trace")).otherwise(F.concat("trace", F.array("parent"))).alias("trace"))
    return now.select("items", "trace")


def markov_clusters(edges: DataFrame, power: int = 2, inflation: float = 2.0, rounds: int = 5, least: float = 1e-6) -> DataFrame:
    """Markov clustering of a weighted graph (i, j, v): expansion, inflation and column normalisation, as matrix joins; (j, cluster).

    Entries under ``least`` are dropped after each round, which keeps the matrix sparse.
    """

    def normalised(m: DataFrame) -> DataFrame:
        return m.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy("j")))

    nodes = edges.select("i").union(edges.select("j")).distinct()
    both = edges.select("i", "j", "v").union(edges.select("j", "i", "v")).union(nodes.select("i", "i", F.lit(1.0)))
    now = normalised(both.toDF("i", "j", "v").groupBy("i", "j").agg(F.max("v").alias("v")))
    for _ in range(rounds):
        base = now
        for _ in range(power - 1):
            now = now.select("i", F.col("j").alias("k"), F.col("v").alias("a")).join(base.select(F.col("i").alias("k"), "j", F.col("v").alias("b")), "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))
        now = cut(normalised(now.withColumn("v", F.pow("v", F.lit(inflation)))).where(F.col("v") > least))
    return now.groupBy("j").agg(F.max_by("i", F.struct("v", -F.col("i"))).alias("cluster"))

