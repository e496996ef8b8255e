"""Itemsets, lattices, clusters and samples over embeddings (dimension on if its value is over a cutoff), orders and events.

Supports are shares of the rows, over all dimensions, and sets may have any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import itemsets as it
from ..operators import lattice as op
from ..operators import maintained
from ..operators import sampling as sa
from ..operators.concepts import formal_concepts as concepts_of
from ..operators.labelling import centroids
from ..operators.maxminer import least_count, max_miner
from .tables import LONG, events, frames, rounded, table

CUT = 0.1
#: Least supports, as shares of the rows: of a lattice's nodes, and of sets that no lattice is made of.
SHARE, RARE = 0.02, 0.015
LOW, HIGH, BINS = -0.5, 0.5, 20


def _least(spark: SparkSession, sf: str, share: float) -> int:
    rows = frames(spark, sf)
    return least_count(rows, share, rows.count())


def _on(spark: SparkSession, sf: str) -> DataFrame:
    return it.contacts(frames(spark, sf), "vec_id", "x", CUT)


def _values(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).select(F.col("vec_id").alias("tid"), F.posexplode("x").alias("feature", "x"))


def _key(c: str = "items") -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


def itemsets_k2(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of suppliers that occur in at least two orders."""
    baskets = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tid"), F.col("l_suppkey").alias("item"))
    found = it.frequent_itemsets(baskets, 2, 2).where(F.size("items") == 2)
    return found.select(F.get("items", 0).alias("a"), F.get("items", 1).alias("b"), "support")


def itemsets_k3(spark: SparkSession, sf: str) -> DataFrame:
    found = it.frequent_itemsets(_on(spark, sf), _least(spark, sf, RARE), 3)
    return found.where(F.size("items") == 3).select(_key(), "support")


def itemsets_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Itemsets of any size with support over (not at) a count."""
    return it.frequent_itemsets(_on(spark, sf), _least(spark, sf, RARE), strict=True).select(_key(), "support")


def maximal_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    return max_miner(_on(spark, sf), _least(spark, sf, RARE))[0].select(_key(), "support")


def closed_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    """Closed sets with enough rows, one item or more."""
    return concepts_of(_on(spark, sf), _least(spark, sf, RARE)).where(F.size("items") > 0).select(_key(), "support")


def formal_concepts(spark: SparkSession, sf: str) -> DataFrame:
    """All concepts of the order lines by flag, status, and steps of quantity and discount; lines of one number in an order count as one."""
    steps = [F.when(F.col("l_quantity") >= q, F.lit(f"quantity {q}")) for q in (10, 20, 30, 40)] + [F.when(F.col("l_discount") >= d / 100, F.lit(f"discount {d}")) for d in (3, 6)]
    marks = F.array(F.concat(F.lit("flag "), "l_returnflag"), F.concat(F.lit("status "), "l_linestatus"), *steps)
    lines = table(spark, sf, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("tid"), F.explode(F.array_compact(marks)).alias("item"))
    return concepts_of(lines).select(F.array_join("items", ",").alias("items"), "support")


def itemset_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Items common to all vectors that have the items 0, 1 and 2."""
    return rounded(it.closure(it.contacts(frames(spark, sf), "vec_id", "x", 0.0), [0, 1, 2]))


def unique_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return it.patterns(_on(spark, sf)).select(_key(), "n", F.array_join("tids", ",").alias("tids"))


def feature_reduction(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    return rounded(it.reduce_features(it.contacts(f, "vec_id", "x", 0.05), f.count(), 0.2, 20))


def feature_elimination(spark: SparkSession, sf: str) -> DataFrame:
    """Dimensions that are often positive and neither go along with another one nor against it."""
    f = frames(spark, sf)
    return rounded(it.eliminate_features(it.contacts(f, "vec_id", "x", 0.0), f.count(), 0.44))


def _lattice(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    on = _on(spark, sf)
    nodes = cut(it.lattice_nodes(max_miner(on, _least(spark, sf, SHARE))[0]))
    return on, nodes, it.lattice_edges(nodes)


def _weighted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    on, nodes, edges = _lattice(spark, sf)
    means = it.own_bins(nodes, on, _values(spark, sf), LOW, HIGH, BINS).select("items", "feature", (F.col("total") / F.col("n")).alias("mean_bin"))
    return on, nodes, cut(it.edge_weights(edges, means, BINS))


def lattice_members(spark: SparkSession, sf: str) -> DataFrame:
    on, nodes, _ = _lattice(spark, sf)
    return it.members(nodes, on).groupBy("items").agg(F.count("*").alias("n"), F.sum("tid").alias("tids")).select(_key(), "n", "tids")


def lattice_edges_emd(spark: SparkSession, sf: str) -> DataFrame:
    _, _, edges = _weighted(spark, sf)
    return rounded(edges.select(_key("child"), _key("parent"), "emd"))


def lattice_collapse(spark: SparkSession, sf: str) -> DataFrame:
    _, nodes, edges = _weighted(spark, sf)
    return rounded(op.collapse(edges, nodes, 0.8, it.longest(nodes)).select(_key("root"), _key("items"), "weight"))


def lattice_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the groups in which nodes follow their closest parent."""
    _, nodes, edges = _weighted(spark, sf)
    return op.groups_by_best_parent(edges, nodes, 1.0, it.longest(nodes)).groupBy("root").agg(F.count("*").alias("n")).select(_key("root"), "n")


def lattice_compression(spark: SparkSession, sf: str) -> DataFrame:
    """Per node: rows, and rows that none of its parents has."""
    on, nodes, edges = _lattice(spark, sf)
    return it.own_rows(nodes, on, edges).select(_key(), "n", "own")


def lattice_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Number of downward paths by root and length."""
    _, nodes, edges = _lattice(spark, sf)
    roots = nodes.join(edges.select(F.col("child").alias("items")).distinct(), "items", "left_anti")
    return rounded(op.paths(edges, roots, it.longest(nodes)).groupBy("root", F.size("path").alias("steps")).agg(F.count("*").alias("n")).select(_key("root"), "steps", "n"))


def covering_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of dimensions, among those that are over 0.2 together in a vector, that cover all such dimensions."""
    on = it.contacts(frames(spark, sf), "vec_id", "x", 0.2)
    pairs = on.join(on.withColumnRenamed("item", "other"), "tid").where("item < other").select("item", "other")
    return rounded(it.cover_pairs(pairs, "item", "other"))


def lattice_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Length and end of each node's way up by best parents."""
    _, nodes, edges = _weighted(spark, sf)
    found = op.traces(edges, nodes, it.longest(nodes))
    return rounded(found.select(_key(), F.size("trace").alias("steps"), F.array_join(F.element_at("trace", -1), ",").alias("top")))


def key_meet_join(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the meet and the join of each vector's key with the next one's, and whether it holds the items 0 and 1."""
    keys = _on(spark, sf).groupBy("tid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    after = keys.select((F.col("tid") - 1).alias("tid"), F.col("items").alias("other"))
    return rounded(keys.join(after, "tid").select("tid", F.size(it.meet("items", "other")).alias("common"), F.size(it.join("items", "other")).alias("either"), it.contains_all("items", [0, 1]).alias("both")))


def label_cluster_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the labels from the scores of seven clusters, by the labels' shares in each."""
    f = frames(spark, sf).withColumn("cluster", F.col("vec_id") % 7)
    scores = f.select("cluster").distinct().select(F.col("cluster").alias("final"), (F.col("cluster") / 7).alias("score"))
    return rounded(op.label_scores(f, "cluster", "label", scores))


def fairness(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of the event types: how common they are, and how long ago they came last."""
    e = events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    w = Window.partitionBy()
    return rounded(e.select("event_type", sa.fairness_weight(F.col("n") / F.max("n").over(w), F.col("last") / (F.max("last").over(w) + 1), 0.7, 0.3).alias("weight")))


def merged_supports(spark: SparkSession, sf: str) -> DataFrame:
    """Supports of two halves of the rows, mined on their own and merged: the same as of all rows."""
    on = _on(spark, sf)
    parts = [it.frequent_itemsets(on.where(F.col("tid") % 2 == k), 1, 2) for k in (0, 1)]
    return it.merge_supports(parts[0], parts[1], _least(spark, sf, SHARE)).select(_key(), "support")


def _halves(spark: SparkSession, sf: str) -> maintained.Lattice:
    """The lattice of the rows of even ids, merged with that of the rows of odd ids."""
    ids = table(spark, sf, "embeddings").agg(F.count_if(F.col("vec_id") % 2 == 0), F.count_if(F.col("vec_id") % 2 == 1)).first()
    built = []
    for k in (0, 1):
        part = [df.where(F.col("tid") % 2 == k).withColumn("tid", F.floor(F.col("tid") / 2)) for df in (_on(spark, sf), _values(spark, sf))]
        built.append(maintained.build(*part, ids[k], SHARE, (LOW, HIGH, BINS)))
    return maintained.merge(*built)


def lattice_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of two merged lattices, with the number and sum of their rows, those of the second batch numbered after the first."""
    return _halves(spark, sf).rows.groupBy("items").agg(F.count("*").alias("n"), F.sum("tid").alias("tids")).select(_key(), "n", "tids")


def lattice_merge_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted edges of two merged lattices: those of all rows."""
    return rounded(_halves(spark, sf).edges.select(_key("child"), _key("parent"), "emd"))


def lattice_extend(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted edges of a lattice without the last dimension, to which it is then added."""
    on, values = _on(spark, sf), _values(spark, sf)
    last = values.agg(F.max("feature")).first()[0]
    old = maintained.build(on.where(F.col("item") < last), values.where(F.col("feature") < last), frames(spark, sf).count(), SHARE, (LOW, HIGH, BINS))
    new = maintained.extend(old, on.where(F.col("item") == last), values.where(F.col("feature") == last))
    return rounded(new.edges.select(_key("child"), _key("parent"), "emd"))


def cuboid_assignment(spark: SparkSession, sf: str) -> DataFrame:
    on, nodes, _ = _lattice(spark, sf)
    return rounded(op.assign_rows(on, nodes, 64).groupBy("level").agg(F.count("*").alias("n")))


def _clusters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Four final clusters of the label clusters, and the rows with their final cluster."""
    f = frames(spark, sf)
    summary = op.summaries(f, "label", "x")
    mapping = op.hierarchical_merge(summary, 4)
    return op.merged_summaries(summary, mapping), f.join(F.broadcast(mapping.withColumnRenamed("cluster", "label")), "label")


def cluster_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Size and variance of the label clusters, from sums that merge."""
    f = frames(spark, sf)
    summary = op.summaries(f, "label", "x")
    own = summary.select("cluster", F.col("cluster").alias("final"))
    return rounded(op.merged_summaries(summary, own).select("final", "n", "variance"))


def cluster_scores(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    summary = op.summaries(f, "label", "x")
    scored = op.cluster_scores(op.merged_summaries(summary, summary.select("cluster", F.col("cluster").alias("final"))), 2)
    return rounded(scored.select("final", "n", "variance", "score"))


def hierarchical_clusters(spark: SparkSession, sf: str) -> DataFrame:
    clusters, _ = _clusters(spark, sf)
    return rounded(op.well_transition_scores(op.cluster_scores(clusters, 4)).select("final", "n", "variance", "score", "well", "transition", "crowd"))


def ranked_members(spark: SparkSession, sf: str) -> DataFrame:
    """The three members of each label nearest to its centroid."""
    f = frames(spark, sf)
    centres = centroids(f, "label", "x").select(F.col("state").alias("final"), F.col("c").alias("centroid"))
    return rounded(op.ranked_members(f, "label", "vec_id", "x", centres).where("rank <= 3").select("label", "vec_id", "d", "rank"))


def cuboid_scores(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    centres = centroids(f, "label", "x").select(F.col("state").alias("final"), F.col("c").alias("centroid"))
    return rounded(op.cuboid_scores(op.ranked_members(f, "label", "vec_id", "x", centres), "label"))


def markov_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Markov clusters of the dimensions by how often they are on together."""
    on = it.contacts(frames(spark, sf), "vec_id", "x", CUT)
    pairs = it.frequent_itemsets(on, 2, 2).where(F.size("items") == 2).select(F.get("items", 0).alias("i"), F.get("items", 1).alias("j"), F.col("support").cast("double").alias("v"))
    return rounded(op.markov_clusters(pairs, rounds=4))


def umbrella_pdf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sa.umbrella_pdf(events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))).select("event_type", "n", "p"))


def mean_umbrella_pdf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sa.mean_umbrella_pdf(events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))).select("user_id", "n", "p"))


def convergence_pdf(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import stats

    own = stats.bootstrap_std(events(spark, sf), "value", "user_id")
    return rounded(sa.normalised(own.withColumn("conv", stats.convergence(F.col("mean"), F.col("ci"))), "conv").select("user_id", "conv", "p"))


def reservoir_bottomk(spark: SparkSession, sf: str) -> DataFrame:
    return sa.bottom_k(events(spark, sf), ["event_type"], "event_id", 20).select("event_type", "event_id", "h")


def reservoir_state(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return rounded(sa.reservoir_state(sa.bottom_k(e, ["user_id"], "event_id", 40), e, ["user_id"]))


def uniform_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sa.uniform(events(spark, sf), "event_id", 100, 7).select("event_id", "event_type")


def select_value(spark: SparkSession, sf: str) -> DataFrame:
    return sa.select_value(events(spark, sf), "event_type", "signup", "event_id", 50).select("event_id", "user_id")


def round_robin_sample(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sa.round_robin(events(spark, sf), "event_type", "event_id", 52).select("event_type", "event_id", "turn"))


def capped_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sa.capped(frames(spark, sf), "label", "vec_id", 15).select("label", "vec_id"))


def lattice_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Draws from the label clusters by score, nearest members first."""
    f = frames(spark, sf)
    summary = op.summaries(f, "label", "x")
    scored = op.cluster_scores(op.merged_summaries(summary, summary.select("cluster", F.col("cluster").alias("final"))), 2)
    pdf = sa.normalised(scored, "score").select(F.col("final").alias("label"), "p")
    members = op.ranked_members(f, "label", "vec_id", "x", scored).select("label", "vec_id", "rank")
    return rounded(sa.draw_members(sa.weighted_draws(pdf, "label", "p", 60), members, "label", "rank"))


def correlation_features(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    return rounded(sa.correlation_features(_on(spark, sf), f.count(), 0.01, 0.2))


def knapsack_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """The parts whose size, price and weight fit best, up to a total size."""
    p = table(spark, sf, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("v"), "p_size")
    scores = sa.knapsack_scores(p, "p_partkey", "v", [30.0, 1500.0])
    return rounded(sa.knapsack_fill(p.join(scores, "p_partkey"), "p_partkey", "score", "p_size", 2000.0).select("p_partkey", "score", "filled"))


def knapsack_oscillation(spark: SparkSession, sf: str) -> DataFrame:
    """Ten parts whose sizes and prices add up to a goal, best first and then exchanged; what is missing before and after."""
    p = table(spark, sf, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100).alias("v"))
    goal = [300.0, 110.0]
    first = sa.knapsack_scores(p, "p_partkey", "v", [g / 10 for g in goal]).orderBy(F.desc("score"), "p_partkey").limit(10)
    found, before, after = sa.knapsack_oscillate(p, first, "p_partkey", "v", goal, 20)
    return rounded(found.withColumns({"before": F.lit(before), "after": F.lit(after)}))


def explorer_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Forty draws of labels by their members' mean total of absolute values, each taking the next member by the sum over the label's positive dimensions."""
    f = frames(spark, sf)
    centres = centroids(f, "label", "x").select(F.col("state").alias("label"), "c")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    key = total(F.zip_with("x", "c", lambda v, c: F.when(c > 0, F.abs(v)).otherwise(0.0)))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("key"), "vec_id"))
    members = f.join(F.broadcast(centres), "label").withColumn("key", key).withColumn("rank", rank).select("label", "vec_id", "rank")
    weights = f.groupBy("label").agg(F.avg(total(F.transform("x", F.abs))).alias("w"))
    return rounded(sa.explorer_draws(members, weights, "label", "rank", 40).select("label", "vec_id", "rank"))


def aged_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred best orders of two queues; the older queue's prices age by its dates."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("priority"), F.datediff("o_orderdate", F.lit("1990-01-01")).cast("double").alias("day"))
    return rounded(sa.aged_merge(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "priority", "day", 4000.0, 100), 4)


def top_unexecuted(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    done = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).where("c_custkey % 3 = 0").distinct()
    return rounded(sa.top_unexecuted(c, done, "c_custkey", "c_acctbal", 25))


QUERIES = {f.__name__: f for f in (itemsets_k2, itemsets_k3, itemsets_strict, maximal_itemsets, closed_itemsets, formal_concepts, itemset_closure, unique_patterns, feature_reduction, feature_elimination, lattice_members, lattice_edges_emd, lattice_collapse, lattice_groups, lattice_compression, lattice_paths, covering_pairs, lattice_traces, key_meet_join, label_cluster_scores, fairness, merged_supports, lattice_merge, lattice_merge_edges, lattice_extend, cuboid_assignment, cluster_summaries, cluster_scores, hierarchical_clusters, ranked_members, cuboid_scores, markov_clusters, umbrella_pdf, mean_umbrella_pdf, convergence_pdf, reservoir_bottomk, reservoir_state, uniform_sample, select_value, round_robin_sample, capped_clusters, lattice_sample, correlation_features, knapsack_greedy, knapsack_oscillation, explorer_sample, aged_queue, top_unexecuted)}

_ON = f"{LONG}, o AS (SELECT vec_id AS tid, i AS item, v FROM x WHERE v > {CUT})"
_S = "array_to_string(items, ',') AS items"


def _sets(share: float, over: str = ">=", tid: str = "tid") -> str:
    """All sets with enough rows, of any size, with their rows."""
    return f"""{_ON}, z AS (SELECT ceil({share} * count(*)) AS least FROM embeddings),
    s AS (SELECT item, list({tid} ORDER BY tid) AS tids FROM o GROUP BY item HAVING count(*) {over} (SELECT least FROM z)),
    f AS (SELECT [item] AS items, tids FROM s UNION ALL SELECT list_append(f.items, s.item), list_intersect(f.tids, s.tids) FROM f JOIN s ON s.item > f.items[len(f.items)] CROSS JOIN z WHERE len(list_intersect(f.tids, s.tids)) {over} z.least)"""


_PARTS = ", u AS (SELECT items, len(tids) AS support, unnest(items) AS gone FROM f WHERE len(items) > 1), w1 AS (SELECT DISTINCT list_filter(items, lambda y: y <> gone) AS items, support FROM u)"
_NODES = f"{_sets(SHARE)}, nd AS (SELECT items, row_number() OVER () AS id FROM f), mb AS (SELECT items, unnest(tids) AS tid FROM f)"
_EDGES = f"{_NODES}, e AS (SELECT list_filter(items, lambda y: y <> gone) AS child, items AS parent FROM (SELECT items, unnest(items) AS gone FROM f WHERE len(items) > 1))"
_EMD = f"""{_EDGES}, h AS (SELECT mb.items, x.i AS feature, least(floor((x.v - ({LOW})::DOUBLE) * {BINS} / 1.0::DOUBLE), {BINS - 1}) AS bin FROM mb JOIN x ON x.vec_id = mb.tid WHERE list_contains(mb.items, x.i) AND x.v BETWEEN {LOW} AND {HIGH}),
    hp AS (SELECT items, feature, avg(bin) AS mean FROM h GROUP BY ALL),
    ef AS (SELECT child, parent, unnest(child) AS feature FROM e),
    w AS (SELECT ef.child, ef.parent, sqrt(sum(((p.mean - c.mean) / {BINS - 1}) * ((p.mean - c.mean) / {BINS - 1}))) AS emd FROM ef JOIN hp c ON c.items = ef.child AND c.feature = ef.feature JOIN hp p ON p.items = ef.parent AND p.feature = ef.feature GROUP BY ef.child, ef.parent)"""
_DIST = "c AS (SELECT label AS state, i, avg(v) AS v FROM x GROUP BY ALL), d AS (SELECT x.vec_id, any_value(x.label) AS label, sqrt(sum((x.v - c.v) * (x.v - c.v))) AS d FROM x JOIN c ON x.i = c.i AND x.label = c.state GROUP BY x.vec_id)"
_SUMS = "mo AS (SELECT label, i, count(*) AS n, var_samp(v) AS q FROM x GROUP BY ALL), cl AS (SELECT label::BIGINT AS final, max(n) AS n, sum(q) AS variance FROM mo GROUP BY label)"


def _h(c: str, seed: int = 0) -> str:
    one = f"((((({c}) + {seed}) % 2147483648) * 1103515245 + 12345) % 2147483648)"
    return f"((xor({one}, {one} >> 15) * 1103515245 + 12345) % 2147483648)"


ORACLE_SQL = {
    "itemsets_k2": "WITH o AS (SELECT DISTINCT l_orderkey AS t, l_suppkey AS i FROM lineitem) SELECT x.i AS a, y.i AS b, count(*) AS support FROM o x JOIN o y ON x.t = y.t AND x.i < y.i GROUP BY ALL HAVING count(*) >= 2",
    "itemsets_k3": f"WITH RECURSIVE {_sets(RARE)} SELECT {_S}, len(tids) AS support FROM f WHERE len(items) = 3",
    "itemsets_strict": f"WITH RECURSIVE {_sets(RARE, '>')} SELECT {_S}, len(tids) AS support FROM f",
    "maximal_itemsets": f"WITH RECURSIVE {_sets(RARE)}{_PARTS} SELECT {_S}, len(tids) AS support FROM f WHERE items NOT IN (SELECT items FROM w1)",
    "closed_itemsets": f"WITH RECURSIVE {_sets(RARE)}{_PARTS} SELECT {_S}, len(tids) AS support FROM f WHERE NOT EXISTS (SELECT 1 FROM w1 WHERE w1.items = f.items AND w1.support = len(f.tids))",
    "formal_concepts": """WITH RECURSIVE m AS (SELECT l_orderkey, l_linenumber, unnest(['flag ' || l_returnflag, 'status ' || l_linestatus, CASE WHEN l_quantity >= 10 THEN 'quantity 10' END, CASE WHEN l_quantity >= 20 THEN 'quantity 20' END, CASE WHEN l_quantity >= 30 THEN 'quantity 30' END,
        CASE WHEN l_quantity >= 40 THEN 'quantity 40' END, CASE WHEN l_discount >= 0.03 THEN 'discount 3' END, CASE WHEN l_discount >= 0.06 THEN 'discount 6' END]) AS item FROM lineitem),
        t AS (SELECT list_sort(list(DISTINCT item)) AS items FROM m WHERE item IS NOT NULL GROUP BY l_orderkey, l_linenumber), p AS (SELECT items, count(*) AS n FROM t GROUP BY 1),
        c AS (SELECT items FROM p UNION SELECT list_sort(list_intersect(c.items, p.items)) FROM c JOIN p ON true)
        SELECT array_to_string(c.items, ',') AS items, sum(n)::BIGINT AS support FROM c JOIN p ON list_has_all(p.items, c.items) GROUP BY c.items""",
    "itemset_closure": f"WITH {LONG}, o AS (SELECT vec_id, i FROM x WHERE v > 0), h AS (SELECT vec_id FROM o WHERE i IN (0, 1, 2) GROUP BY 1 HAVING count(*) = 3) SELECT i AS item FROM o WHERE vec_id IN (FROM h) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM h)",
    "unique_patterns": f"WITH {LONG}, p AS (SELECT vec_id, list(i ORDER BY i) AS items FROM x WHERE v > {CUT} GROUP BY 1) SELECT {_S}, count(*) AS n, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS tids FROM p GROUP BY p.items",
    "feature_reduction": f"""WITH {LONG}, o AS (SELECT vec_id AS tid, i AS item FROM x WHERE v > 0.05), n AS (SELECT count(*) AS n FROM embeddings), s AS (SELECT item, count(*) AS ones FROM o GROUP BY 1), k AS (SELECT s.* FROM s, n WHERE ones >= 0.2 * n AND ones <= n - 0.2 * n),
        d AS (SELECT a.item AS a, b.item AS b, any_value(ka.ones) + any_value(kb.ones) - 2 * count(*) AS diff FROM o a JOIN o b ON a.tid = b.tid AND a.item < b.item JOIN k ka ON ka.item = a.item JOIN k kb ON kb.item = b.item GROUP BY a.item, b.item)
        SELECT item, ones FROM k WHERE item NOT IN (SELECT a FROM d, n WHERE diff < 0.4 * n) ORDER BY ones, item LIMIT 20""",
    "feature_elimination": f"""WITH {LONG}, n AS (SELECT count(*) AS n FROM embeddings), k AS (SELECT i AS item, count(*) FILTER (v > 0) AS ones FROM x GROUP BY 1 HAVING count(*) FILTER (v > 0) >= 0.44 * (SELECT n FROM n)),
        p AS (SELECT a.i AS a, b.i AS b, count(*) FILTER ((a.v > 0) = (b.v > 0)) AS same FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i < b.i WHERE a.i IN (SELECT item FROM k) AND b.i IN (SELECT item FROM k) GROUP BY ALL),
        c AS (SELECT a, b FROM p, n WHERE same < 0.44 * n OR same > n - 0.44 * n)
        SELECT item, ones FROM k WHERE item NOT IN (SELECT a FROM c) AND item NOT IN (SELECT b FROM c)""",
    "lattice_members": f"WITH RECURSIVE {_NODES} SELECT {_S}, count(*) AS n, sum(tid)::BIGINT AS tids FROM mb GROUP BY mb.items",
    "lattice_edges_emd": f"WITH RECURSIVE {_EMD} SELECT array_to_string(child, ',') AS child, array_to_string(parent, ',') AS parent, round(emd, 6) AS emd FROM w",
    "lattice_collapse": f"""WITH RECURSIVE {_EMD}, cs AS (SELECT child, parent, 1 - emd AS sim FROM w WHERE 1 - emd >= 0.8), up AS (SELECT items AS root, items, 1.0::DOUBLE AS weight FROM nd WHERE items NOT IN (SELECT child FROM cs)
        UNION ALL SELECT up.root, cs.child, up.weight * cs.sim FROM up JOIN cs ON cs.parent = up.items)
        SELECT array_to_string(root, ',') AS root, array_to_string(items, ',') AS items, round(max(weight), 6) AS weight FROM up GROUP BY up.root, up.items""",
    "lattice_groups": f"""WITH RECURSIVE {_EMD}, b AS (SELECT child, parent, row_number() OVER (PARTITION BY child ORDER BY emd, parent) AS r FROM w WHERE emd <= 1), up AS (SELECT child, parent FROM b WHERE r = 1),
        g AS (SELECT items, items AS root FROM nd UNION ALL SELECT g.items, up.parent FROM g JOIN up ON up.child = g.root),
        t AS (SELECT items, max_by(root, len(root)) AS root FROM g GROUP BY items)
        SELECT array_to_string(root, ',') AS root, count(*) AS n FROM t GROUP BY t.root""",
    "lattice_compression": f"""WITH RECURSIVE {_EDGES}, cv AS (SELECT DISTINCT e.child AS items, mb.tid FROM e JOIN mb ON mb.items = e.parent)
        SELECT array_to_string(mb.items, ',') AS items, count(*) AS n, count(*) FILTER (cv.tid IS NULL) AS own FROM mb LEFT JOIN cv ON mb.items = cv.items AND mb.tid = cv.tid GROUP BY mb.items""",
    "lattice_paths": f"""WITH RECURSIVE {_EDGES}, pa AS (SELECT items AS root, items AS node, 1 AS steps FROM nd WHERE items NOT IN (SELECT child FROM e) UNION ALL SELECT root, e.child, steps + 1 FROM pa JOIN e ON e.parent = pa.node)
        SELECT array_to_string(root, ',') AS root, steps::BIGINT AS steps, count(*) AS n FROM pa GROUP BY pa.root, steps""",
    "covering_pairs": f"""WITH {LONG}, o AS (SELECT vec_id, i FROM x WHERE v > 0.2), p AS (SELECT DISTINCT a.i AS item, b.i AS other FROM o a JOIN o b ON a.vec_id = b.vec_id AND a.i < b.i), e AS (SELECT item AS r FROM p UNION ALL SELECT other FROM p),
        g AS (SELECT r, count(*) AS n FROM e GROUP BY 1), k AS (SELECT item, other, x.n + y.n AS d FROM p JOIN g x ON x.r = item JOIN g y ON y.r = other), u AS (SELECT item AS r, * FROM k UNION ALL SELECT other, * FROM k)
        SELECT DISTINCT arg_min(item, (d, item, other)) AS item, arg_min(other, (d, item, other)) AS other FROM u GROUP BY r""",
    "lattice_traces": f"""WITH RECURSIVE {_EMD}, b AS (SELECT child, parent, row_number() OVER (PARTITION BY child ORDER BY emd, parent) AS r FROM w), up AS (SELECT child, parent FROM b WHERE r = 1),
        g AS (SELECT items, items AS top, 1 AS steps FROM nd UNION ALL SELECT g.items, up.parent, steps + 1 FROM g JOIN up ON up.child = g.top), t AS (SELECT items, max(steps) AS steps, max_by(top, steps) AS top FROM g GROUP BY items)
        SELECT {_S}, steps::BIGINT AS steps, array_to_string(top, ',') AS top FROM t""",
    "key_meet_join": f"WITH {_ON}, k AS (SELECT tid, list(item) AS items FROM o GROUP BY 1) SELECT a.tid, len(list_intersect(a.items, b.items)) AS common, len(list_distinct(list_concat(a.items, b.items))) AS either, list_has_all(a.items, [0, 1]) AS both FROM k a JOIN k b ON b.tid = a.tid + 1",
    "label_cluster_scores": "WITH c AS (SELECT vec_id % 7 AS cluster, label, count(*) AS c FROM embeddings GROUP BY ALL), s AS (SELECT *, c / (sum(c) OVER (PARTITION BY cluster))::DOUBLE AS share FROM c) SELECT label::BIGINT AS label, round(sum(share * cluster / 7.0::DOUBLE), 6) AS score FROM s GROUP BY label",
    "fairness": "WITH e AS (SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1) SELECT event_type, round(0.7::DOUBLE * n / max(n) OVER () + 0.3::DOUBLE * (1 - last / (max(last) OVER () + 1)::DOUBLE), 6) AS weight FROM e",
    "merged_supports": f"WITH RECURSIVE {_sets(SHARE)} SELECT {_S}, len(tids) AS support FROM f WHERE len(items) <= 2",
    "lattice_merge": f"WITH RECURSIVE {_sets(SHARE, tid='tid // 2 + (tid % 2) * (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 0)')} SELECT {_S}, len(tids) AS n, list_sum(tids)::BIGINT AS tids FROM f",
    "lattice_merge_edges": f"WITH RECURSIVE {_EMD} SELECT array_to_string(child, ',') AS child, array_to_string(parent, ',') AS parent, round(emd, 6) AS emd FROM w",
    "lattice_extend": f"WITH RECURSIVE {_EMD} SELECT array_to_string(child, ',') AS child, array_to_string(parent, ',') AS parent, round(emd, 6) AS emd FROM w",
    "cuboid_assignment": f"""WITH RECURSIVE {_NODES}, p AS (SELECT tid, count(*) AS n FROM o GROUP BY 1), m AS (SELECT tid, max(len(items)) AS k FROM mb GROUP BY 1)
        SELECT n - k AS level, count(*) AS n FROM p JOIN m USING (tid) GROUP BY n - k""",
    "cluster_summaries": f"WITH {LONG}, {_SUMS} SELECT final, n, round(variance, 6) AS variance FROM cl",
    "cluster_scores": f"WITH {LONG}, {_SUMS} SELECT final, n, round(variance, 6) AS variance, round(greatest(min(variance) OVER () / variance + 1 - 4.0 * n / (sum(n) OVER ())::DOUBLE, 0), 6) AS score FROM cl",
    "ranked_members": f"WITH {LONG}, {_DIST}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS rank FROM d) SELECT label::BIGINT AS label, vec_id, round(d, 6) AS d, rank FROM r WHERE rank <= 3",
    "cuboid_scores": f"WITH {LONG}, {_DIST} SELECT label::BIGINT AS label, count(*) AS n, round(avg(d), 6) AS mean_d, round(sum(d), 6) AS total_d FROM d GROUP BY label",
    "umbrella_pdf": "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), w AS (SELECT *, max(n) OVER () + 0.01::DOUBLE * sum(n) OVER () - n AS w FROM c) SELECT event_type, n, round(w / sum(w) OVER (), 6) AS p FROM w",
    "mean_umbrella_pdf": "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), w AS (SELECT *, greatest(1 + avg(n) OVER () - n, 0) AS w FROM c) SELECT user_id, n, round(w / sum(w) OVER (), 6) AS p FROM w",
    "convergence_pdf": "WITH c AS (SELECT user_id, least(1.645::DOUBLE * stddev_pop(value) / sqrt(count(*)) / avg(value), 1) AS conv FROM events GROUP BY 1) SELECT user_id, round(conv, 6) AS conv, round(conv / sum(conv) OVER (), 6) AS p FROM c",
    "reservoir_bottomk": f"WITH h AS (SELECT event_type, event_id, {_h('event_id')} AS h FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) AS k FROM h) SELECT event_type, event_id, h FROM r WHERE k <= 20",
    "reservoir_state": "WITH c AS (SELECT user_id, count(*) AS seen FROM events GROUP BY 1) SELECT user_id, seen, least(seen, 40) AS size, seen - least(seen, 40) AS spill, round(least(seen, 40) / seen::DOUBLE, 6) AS percent FROM c",
    "uniform_sample": f"SELECT event_id, event_type FROM events ORDER BY {_h('event_id', 7)}, event_id LIMIT 100",
    "select_value": f"SELECT event_id, user_id FROM events WHERE event_type = 'signup' ORDER BY {_h('event_id')}, event_id LIMIT 50",
    "round_robin_sample": f"SELECT event_type, event_id, turn FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY {_h('event_id')}, event_id) AS turn FROM events) ORDER BY turn, event_type LIMIT 52",
    "capped_clusters": f"SELECT label::BIGINT AS label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY {_h('vec_id')}, vec_id) AS k FROM embeddings) WHERE k <= 15",
    "correlation_features": f"WITH {_ON}, p AS (SELECT a.item, b.item AS other, count(*) / (SELECT count(*) FROM embeddings)::DOUBLE AS s FROM o a JOIN o b ON a.tid = b.tid AND a.item <> b.item GROUP BY a.item, b.item) SELECT item, round(avg(s), 6) AS score FROM p GROUP BY item HAVING avg(s) BETWEEN 0.01 AND 0.2",
    "knapsack_greedy": "WITH s AS (SELECT p_partkey, p_size, least(p_size / 30.0::DOUBLE, 1) + least(p_retailprice / 1500.0::DOUBLE, 1) AS score FROM part), f AS (SELECT *, sum(p_size) OVER (ORDER BY score DESC, p_partkey)::BIGINT AS filled FROM s) SELECT p_partkey, round(score, 6) AS score, filled FROM f WHERE filled <= 2000",
    "explorer_sample": f"""WITH {LONG}, c AS (SELECT label, i, avg(v) AS c FROM x GROUP BY ALL), w AS (SELECT label, sum(abs(v)) / count(DISTINCT vec_id) AS w FROM x GROUP BY 1),
        m AS (SELECT x.label, vec_id, sum(CASE WHEN c > 0 THEN abs(v) ELSE 0 END) AS key FROM x JOIN c ON c.label = x.label AND c.i = x.i GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY key DESC, vec_id) AS rank FROM m),
        a AS (SELECT r.label, vec_id, rank, sum(-ln(({_h(_h('r.label::BIGINT') + ' + rank * 1000003')} + 0.5::DOUBLE) / 2147483648.0::DOUBLE) / w) OVER (PARTITION BY r.label ORDER BY rank) AS waited FROM r JOIN w USING (label))
        SELECT label::BIGINT AS label, vec_id, rank FROM a ORDER BY waited, label LIMIT 40""",
    "aged_queue": "WITH o AS (SELECT o_orderkey, o_totalprice AS p, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::DOUBLE AS day FROM orders), u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN p * day / 4000 ELSE p END AS priority, day FROM o) SELECT o_orderkey, round(priority, 4) AS priority, day FROM u ORDER BY priority DESC, day DESC LIMIT 100",
    "top_unexecuted": "SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0) ORDER BY c_acctbal DESC, c_custkey LIMIT 25",
}
