"""Frequent itemsets over transactions (tid, item), level by level, and the lattice they span.

Itemsets are sorted arrays. The levels keep their transaction lists, (items, tid), because
lattice nodes need them. Pairs are made of each transaction's items; every further level is one
equi-join on (tid, common prefix) and one count, and its lineage is cut. Subset tests are never theta joins: a set is exploded into the sets that lack
one of its items, and these are joined by equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from . import bitmaps

#: Rows that a task deals with where lines are made distinct, and pairs that it makes or adds up.
ROWS = 1 << 19


def contacts(rows: DataFrame, tid: str, vector: str, cutoff: float, features: list[int] | None = None, below: bool = False) -> DataFrame:
    """Transactions (tid, item): the places of a vector whose value is over (or below) the cutoff, of ``features`` only if given."""
    parts = rows.select(F.col(tid).alias("tid"), F.posexplode(vector).alias("item", "x"))
    parts = parts.where(F.col("x") < cutoff if below else F.col("x") > cutoff)
    return (parts.where(F.col("item").isin(features)) if features else parts).select("tid", "item")


def supports(lists: DataFrame) -> DataFrame:
    return lists.groupBy("items").agg(F.count("*").alias("support"))


def _candidates(good: DataFrame, size: int) -> DataFrame:
    """(prefix, x, y) of the sets of one item more than ``size`` all of whose subsets of ``size`` items are in ``good``."""
    ends = good.select(F.slice("items", 1, size - 1).alias("prefix"), F.element_at("items", size).alias("x"))
    both = ends.join(ends.withColumnRenamed("x", "y"), "prefix").where("x < y")
    whole = both.withColumn("items", F.concat("prefix", F.array("x", "y")))
    subsets = whole.select("items", F.explode("items").alias("gone")).select("items", F.array_remove("items", F.col("gone")).alias("child"))
    lacking = subsets.join(good.select(F.col("items").alias("child")), "child", "left_anti").select("items").distinct()
    return whole.join(lacking, "items", "left_anti").select("prefix", "x", "y")


def _parts(rows: int) -> int:
    return max(1, -(-rows // ROWS))


def _pairs(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs of items of each transaction, (tid, items), and their supports (items, support), of distinct (tid, item).

    As many parts are dealt as the number of pairs asks for, so that a task's memory does not grow with the input. A part
    adds up its own pairs before they are dealt by pair, so a pair that is everywhere is a row a part.
    """
    known = level.where("tid is not null")
    parts = _parts(known.groupBy("tid").agg(F.count("*").alias("n")).agg(F.expr("sum(n * (n - 1) div 2)")).first()[0] or 0)
    dealt = known.select(F.pmod(F.xxhash64("tid"), F.lit(16 * parts)).alias("deal"), "tid", "item").repartition(parts, "deal")
    held = dealt.groupBy("deal", "tid").agg(F.array_sort(F.collect_list("item")).alias("held"))
    first = held.select("deal", "tid", "held", F.posexplode("held").alias("k", "x"))
    both = first.select("deal", "tid", "x", F.explode(F.slice("held", F.col("k") + 2, F.size("held"))).alias("y"))
    own = both.groupBy("deal", "x", "y").agg(F.count("*").alias("n")).select("x", "y", "n")
    counts = own.repartition(parts, "x", "y").groupBy("x", "y").agg(F.sum("n").alias("support"))
    items = F.array("x", "y").alias("items")
    return both.select("tid", items), counts.select(items, "support")


def frequent_itemsets(transactions: DataFrame, least: int, longest: int | None = None, strict: bool = False) -> DataFrame:
    """Itemsets with support >= least (> least if ``strict``) and that support, of up to ``longest`` items or of any size.

    Pairs are made of each transaction's items, as most pairs of items never meet. From three items on, candidates
    are made of the frequent sets and tested by their subsets first, and only theirs are the transaction
    lists that are joined. The lists of the last level are counted but not kept. Where rows hold a fair
    share of the items, bitmaps count the candidates and there are no lists.
    """
    keep = F.col("support") > least if strict else F.col("support") >= least
    names = bitmaps.dense_names(transactions, least)
    if names is not None:
        return _counted_in_bitmaps(bitmaps.bitmaps(transactions, names), keep, longest)
    rows = transactions.where("item is not null").select("tid", "item")
    lines = cut(rows.repartition(_parts(rows.count()), "tid").distinct())
    lists = lines.select("tid", F.array("item").alias("items"))
    counted = supports(lists)
    found: list[DataFrame] = []
    while longest is None or len(found) < longest:
        good = cut(counted.where(keep))
        found.append(good)
        size = len(found)
        if size == longest or longest is None and not good.limit(1).count():
            break
        if size == 1:
            lists, counted = _pairs(lines.join(good.select(F.get("items", 0).alias("item")), "item", "left_semi"))
            continue
        level = cut(lists.join(good.select("items"), "items", "left_semi").select("items", "tid"))
        prefix = F.slice("items", 1, size - 1)
        a = level.select("tid", prefix.alias("prefix"), F.element_at("items", size).alias("x"))
        b = a.withColumnRenamed("x", "y")
        both = a.join(_candidates(good, size), ["prefix", "x"]).join(b, ["tid", "prefix", "y"])
        lists = both.select("tid", F.concat("prefix", F.array("x", "y")).alias("items"))
        counted = supports(lists)
    return reduce(DataFrame.unionByName, found)


def _counted_in_bitmaps(maps: bitmaps.Bitmaps, keep: Column, longest: int | None) -> DataFrame:
    sets = maps.table.sparkSession.range(len(maps.names)).select(F.array().cast("array<int>").alias("prefix"), F.col("id").cast("int").alias("x"))
    found: list[DataFrame] = []
    while longest is None or len(found) < longest:
        good = cut(bitmaps.supports(maps, sets).where(keep).select(F.concat("prefix", F.array("x")).alias("items"), "support"))
        found.append(good)
        if len(found) == longest or not good.limit(1).count():
            break
        sets = cut(_candidates(good, len(found)).select(F.concat("prefix", F.array("x")).alias("prefix"), F.col("y").alias("x")))
    return reduce(DataFrame.unionByName, found).select(maps.named("items").alias("items"), "support")


def without_one(sets: DataFrame, *keep: str) -> DataFrame:
    """Each set's subsets that lack one item, as ``child``; ``items`` is renamed parent. Empty subsets are left out."""
    rows = sets.where(F.size("items") > 1).select(*keep, F.col("items").alias("parent"), F.explode("items").alias("gone"))
    return rows.select(*keep, "parent", F.array_remove("parent", F.col("gone")).alias("child"))


def maximal(itemsets: DataFrame) -> DataFrame:
    """Itemsets (of a downward closed table) without a superset in it."""
    return itemsets.join(without_one(itemsets).select(F.col("child").alias("items")).distinct(), "items", "left_anti")


def closed(itemsets: DataFrame) -> DataFrame:
    """Itemsets without a superset of the same support."""
    return itemsets.join(without_one(itemsets, "support").select(F.col("child").alias("items"), "support").distinct(), ["items", "support"], "left_anti")


def closure(transactions: DataFrame, items: list) -> DataFrame:
    """Items that every transaction with all of ``items`` has."""
    distinct = transactions.select("tid", "item").distinct()
    holds = distinct.groupBy("tid").agg(F.count_if(F.col("item").isin(items)).alias("n")).where(F.col("n") == len(set(items))).select("tid")
    inside = distinct.join(holds, "tid", "left_semi")
    return inside.groupBy("item").agg(F.count("*").alias("n")).join(holds.agg(F.count("*").alias("all")), F.expr("n = all")).select("item")


def longest(sets: DataFrame) -> int:
    """Items of the largest set."""
    return sets.agg(F.max(F.size("items"))).first()[0] or 0


def lattice_nodes(maximal_sets: DataFrame) -> DataFrame:
    """All non-empty subsets of the maximal sets, by dropping one item at a time."""
    level, found = maximal_sets.select("items"), [maximal_sets.select("items")]
    for _ in range(longest(maximal_sets) - 1):
        level = without_one(level).select(F.col("child").alias("items")).distinct()
        found.append(level)
    return reduce(DataFrame.unionByName, found).distinct()


def lattice_edges(nodes: DataFrame) -> DataFrame:
    """(child, parent): a parent has one item more than its child, and both are nodes."""
    return without_one(nodes).join(nodes.select(F.col("items").alias("child")), "child", "left_semi").select("child", "parent")


def members(nodes: DataFrame, transactions: DataFrame) -> DataFrame:
    """(items, tid) of the transactions that hold every item of a node: ANDs of bitmaps, or an equi-join on items and a count."""
    maps = bitmaps.dense_for(nodes, transactions)
    if maps is not None:
        return bitmaps.members(maps, nodes)
    wanted = nodes.select("items", F.size("items").alias("size"), F.explode("items").alias("item"))
    hits = transactions.select("tid", "item").distinct().join(wanted, "item").groupBy("items", "size", "tid").agg(F.count("*").alias("n"))
    return hits.where("n = size").select("items", "tid")


def largest_members(nodes: DataFrame, transactions: DataFrame) -> DataFrame:
    """(items, tid): of the nodes whose every item a transaction holds, one of the most items, the lower set first, at least."""
    maps = bitmaps.dense_for(nodes, transactions)
    return members(nodes, transactions) if maps is None else bitmaps.largest(maps, nodes)


def mean_bins(lists: DataFrame, values: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Per node and feature: mean histogram bin of the node's rows, (items, feature, mean_bin, n). ``values`` is (tid, feature, x)."""
    from .stats import bin_of

    binned = values.withColumn("bin", bin_of(F.col("x"), low, high, bins)).where("bin is not null")
    return lists.join(binned, "tid").groupBy("items", "feature").agg(F.avg("bin").alias("mean_bin"), F.count("*").alias("n"))


def own_bins(nodes: DataFrame, transactions: DataFrame, values: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Per node and each of its own items: sum and number of the histogram bins of the node's rows, (items, feature, total, n)."""
    from .stats import bin_of

    binned = values.select("tid", "feature", bin_of(F.col("x"), low, high, bins).alias("bin")).where("bin is not null")
    maps = bitmaps.dense_for(nodes, transactions, binned)
    if maps is not None:
        return bitmaps.bin_sums(maps, nodes)
    wanted = members(nodes, transactions).select("items", "tid", F.explode("items").alias("feature"))
    return wanted.join(binned, ["tid", "feature"]).groupBy("items", "feature").agg(F.sum("bin").alias("total"), F.count("*").alias("n"))


def own_rows(nodes: DataFrame, transactions: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node: its rows, and those that none of its parents has, (items, n, own)."""
    maps = bitmaps.dense_for(nodes, transactions)
    if maps is not None:
        return bitmaps.own_rows(maps, edges, nodes)
    lists = members(nodes, transactions)
    full = lists.groupBy("items").agg(F.count("*").alias("n"))
    own = compress(lists, edges).groupBy("items").agg(F.count("*").alias("own"))
    return full.join(own, "items", "left").select("items", "n", F.coalesce("own", F.lit(0)).alias("own"))


def edge_weights(edges: DataFrame, means: DataFrame, bins: int) -> DataFrame:
    """Adds emd: root of the summed squared flows between the parent's and the child's histograms on the child's features.

    The flow between two normalised one-dimensional histograms is a sum of prefix sums, which is
    linear: it equals the difference of their mean bins. So no bin is ever looped over.
    """
    wide = edges.select("child", "parent", F.explode("child").alias("feature"))
    c = means.select(F.col("items").alias("child"), "feature", F.col("mean_bin").alias("c"))
    p = means.select(F.col("items").alias("parent"), "feature", F.col("mean_bin").alias("p"))
    flow = (F.col("p") - F.col("c")) / (bins - 1)
    return wide.join(c, ["child", "feature"]).join(p, ["parent", "feature"]).groupBy("child", "parent").agg(F.sqrt(F.sum(flow * flow)).alias("emd"))


def merge_supports(a: DataFrame, b: DataFrame, least: int) -> DataFrame:
    """Supports of two batches together; low supports of either are kept by their callers, so sums equal a rebuild."""
    both = a.unionByName(b).groupBy("items").agg(F.sum("support").alias("support"))
    return both.where(F.col("support") >= least)


def compress(lists: DataFrame, edges: DataFrame) -> DataFrame:
    """Transaction lists without the rows that one of the node's parents has."""
    covered = lists.withColumnRenamed("items", "parent").join(edges, "parent").select(F.col("child").alias("items"), "tid").distinct()
    return lists.join(covered, ["items", "tid"], "left_anti")


def decompress(compressed: DataFrame, edges: DataFrame, levels: int) -> DataFrame:
    """The full lists of ``compress``: rows flow down from parents to children, through ``levels`` sizes of sets."""
    full = level = compressed
    for _ in range(levels - 1):
        level = level.withColumnRenamed("items", "parent").join(edges, "parent").select(F.col("child").alias("items"), "tid").distinct()
        full = full.unionByName(level)
    return full.distinct()


def patterns(transactions: DataFrame) -> DataFrame:
    """Distinct item patterns with their rows and number: (items, tids, n)."""
    rows = transactions.groupBy("tid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return rows.groupBy("items").agg(F.array_sort(F.collect_list("tid")).alias("tids"), F.count("*").alias("n"))


def reduce_features(transactions: DataFrame, n_rows: int, theta: float, most: int | None = None) -> DataFrame:
    """Features (item, ones) that are neither rare nor nearly constant nor nearly equal to an earlier one.

    Kept: theta * N <= ones <= N - theta * N; of two features that differ in fewer than
    2 * theta * N rows, the higher stays. With ``most``, the least frequent ones stay.
    """
    distinct = transactions.select("tid", "item").distinct()
    ones = distinct.groupBy("item").agg(F.count("*").alias("ones")).where((F.col("ones") >= theta * n_rows) & (F.col("ones") <= n_rows - theta * n_rows))
    kept = distinct.join(ones.select("item"), "item", "left_semi")
    both = kept.alias("a").join(kept.alias("b"), F.expr("a.tid = b.tid and a.item < b.item")).groupBy(F.col("a.item").alias("a"), F.col("b.item").alias("b")).agg(F.count("*").alias("common"))
    pairs = both.join(ones.select(F.col("item").alias("a"), F.col("ones").alias("na")), "a").join(ones.select(F.col("item").alias("b"), F.col("ones").alias("nb")), "b")
    same = pairs.where(F.col("na") + F.col("nb") - 2 * F.col("common") < 2 * theta * n_rows).select(F.col("a").alias("item")).distinct()
    out = ones.join(same, "item", "left_anti")
    return out.orderBy("ones", "item").limit(most) if most else out


def eliminate_features(transactions: DataFrame, n_rows: int, theta: float) -> DataFrame:
    """Features (item, ones) that at least theta * N rows have and that no other such feature nearly equals or nearly opposes.

    Two features are too close if they agree in fewer than theta * N rows or in more than N - theta * N; then both go.
    """
    distinct = transactions.select("tid", "item").distinct()
    ones = cut(distinct.groupBy("item").agg(F.count("*").alias("ones")).where(F.col("ones") >= theta * n_rows))
    held = distinct.join(ones.select("item"), "item", "left_semi")
    common = held.join(held.withColumnRenamed("item", "other"), "tid").where("item < other").groupBy("item", "other").agg(F.count("*").alias("both"))
    # All pairs of columns, as features without a common row oppose each other too.
    pairs = ones.join(ones.select(F.col("item").alias("other"), F.col("ones").alias("theirs")), F.expr("item < other")).join(common, ["item", "other"], "left")
    same = n_rows - F.col("ones") - F.col("theirs") + 2 * F.coalesce("both", F.lit(0))
    close = pairs.where((same < theta * n_rows) | (same > n_rows - theta * n_rows)).select(F.explode(F.array("item", "other")).alias("item")).distinct()
    return ones.join(close, "item", "left_anti")


def cover_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs (a, b) that a greedy cover of the residues picks: pairs in order of summed degree, then of their residues, each if a residue of it is not covered yet.

    A pair is picked just if it is the first one of one of its residues: such a residue cannot have
    been covered before, and a residue whose first pair came earlier has been. So one minimum for
    each residue gives the cover.
    """
    once = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    ends = once.select("a", "b", F.explode(F.array("a", "b")).alias("r"))
    degree = ends.groupBy("r").agg(F.count("*").alias("degree"))
    known = ends.join(degree, "r").groupBy("a", "b").agg(F.sum("degree").alias("d"))
    first = known.select(F.explode(F.array("a", "b")).alias("r"), F.struct("d", "a", "b").alias("p")).groupBy("r").agg(F.min("p").alias("p"))
    return first.select(F.col("p.a").alias(a), F.col("p.b").alias(b)).distinct()


def meet(a: Column, b: Column) -> Column:
    """The items of both keys, sorted."""
    return F.array_sort(F.array_intersect(a, b))


def join(a: Column, b: Column) -> Column:
    """The items of either key, sorted."""
    return F.array_sort(F.array_union(a, b))


def contains_all(features: Column, key: list) -> Column:
    """Whether an array holds every element of key."""
    return F.size(F.array_except(F.array(*map(F.lit, key)), features)) == 0
