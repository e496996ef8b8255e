"""Lattices as maintained views: tables that a batch of rows or a new feature changes only where it must.

All that a lattice keeps of its rows adds up: supports, row lists and, for each node and feature, the
sum and number of histogram bins. So two lattices merge without mining again. A set that is frequent
in a share of all rows is frequent in that share of one of the batches, hence the merged nodes are
among the nodes of both; only where one side lacks such a set, and its support there is not known
from mining, are that side's transactions asked. Only edges at nodes whose rows changed are weighed
again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .itemsets import edge_weights, lattice_edges, lattice_nodes, members, own_bins, supports
from .maxminer import least_count, max_miner


@dataclass(frozen=True)
class Lattice:
    """A weighted lattice of frequent itemsets.

    ``n`` rows with tids 0..n-1; ``share`` of them is the least support; ``bins`` is (low, high,
    number). Tables: transactions (tid, item), values (tid, feature, x), nodes (items, support), low
    (items, support) of sets known to be infrequent, rows (items, tid), sums (items, feature, total,
    n) of bins on the node's own features, edges (child, parent, emd).
    """

    n: int
    share: float
    bins: tuple[float, float, int]
    transactions: DataFrame
    values: DataFrame
    nodes: DataFrame
    low: DataFrame
    rows: DataFrame
    sums: DataFrame
    edges: DataFrame

    @property
    def least(self) -> int:
        return least_count(self.transactions, self.share, self.n)


def _weighed(edges: DataFrame, sums: DataFrame, bins: tuple[float, float, int]) -> DataFrame:
    return edge_weights(edges, sums.select("items", "feature", (F.col("total") / F.col("n")).alias("mean_bin")), bins[2])


def build(transactions: DataFrame, values: DataFrame, n: int, share: float, bins: tuple[float, float, int]) -> Lattice:
    """The lattice of all subsets of the maximal itemsets, with every edge weighed."""
    maximal, infrequent = max_miner(transactions, least_count(transactions, share, n))
    sets = cut(lattice_nodes(maximal))
    rows = cut(members(sets, transactions))
    nodes, sums = cut(supports(rows)), cut(own_bins(sets, transactions, values, *bins))
    edges = cut(_weighed(lattice_edges(nodes), sums, bins))
    return Lattice(n, share, bins, transactions, values, nodes, infrequent, rows, sums, edges)


def _shifted(df: DataFrame, by: int) -> DataFrame:
    return df.withColumn("tid", F.col("tid") + by)


def merge(a: Lattice, b: Lattice) -> Lattice:
    """The lattice of the rows of ``a`` and then of ``b``, equal to one built anew; both have one share and the same bins."""
    if (a.share, a.bins) != (b.share, b.bins):
        raise ValueError("lattices of different shares or bins")
    n = a.n + b.n
    transactions = a.transactions.unionByName(_shifted(b.transactions, a.n))
    values = a.values.unionByName(_shifted(b.values, a.n))
    least = least_count(transactions, a.share, n)
    known = [x.nodes.unionByName(x.low).groupBy("items").agg(F.max("support").alias(f"n{k}")) for k, x in enumerate((a, b))]
    sets = a.nodes.select("items").union(b.nodes.select("items")).distinct()
    sets = cut(sets.join(known[0], "items", "left").join(known[1], "items", "left"))
    live = sets.where(f"n0 is null or n1 is null or n0 + n1 >= {least}").select("items")
    own, added, fresh = [], [], []
    for x, by in ((a, 0), (b, a.n)):
        lacking = cut(live.join(x.nodes.select("items"), "items", "left_anti"))
        fresh.append(own_bins(lacking, x.transactions, x.values, *a.bins))
        added.append(cut(_shifted(members(lacking, x.transactions), by)))
        own.append(_shifted(x.rows.join(live, "items", "left_semi"), by))
    rows = own[0].unionByName(own[1]).unionByName(added[0]).unionByName(added[1])
    counted = cut(supports(rows))
    nodes = cut(counted.where(F.col("support") >= least))
    rows = cut(rows.join(nodes.select("items"), "items", "left_semi"))
    kept = reduce(DataFrame.unionByName, [a.sums, b.sums, *fresh]).join(nodes.select("items"), "items", "left_semi")
    sums = cut(kept.groupBy("items", "feature").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
    both = known[0].join(known[1], "items").select("items", (F.col("n0") + F.col("n1")).alias("support"))
    low = both.unionByName(counted).where(F.col("support") < least).distinct()
    touched = own[1].select("items").union(added[0].select("items")).union(added[1].select("items")).distinct()
    edges = lattice_edges(nodes)
    changed = [F.col("t0").isNotNull() | F.col("t1").isNotNull()]
    marked = edges.join(touched.select(F.col("items").alias("child"), F.lit(1).alias("t0")), "child", "left").join(touched.select(F.col("items").alias("parent"), F.lit(1).alias("t1")), "parent", "left")
    again = marked.where(changed[0]).select("child", "parent")
    still = a.edges.join(marked.where(~changed[0]).select("child", "parent"), ["child", "parent"], "left_semi")
    return Lattice(n, a.share, a.bins, transactions, values, nodes, cut(low), rows, sums, cut(still.unionByName(_weighed(again, sums, a.bins))))


def extend(a: Lattice, transactions: DataFrame, values: DataFrame) -> Lattice:
    """The lattice with one item more, of which ``transactions`` (tid, item) and ``values`` (tid, feature, x) are given for the same rows.

    Only the rows that have the item are mined, among the items there were; what was known of the
    other sets stays, weights included. Equal to a lattice built anew.
    """
    new = transactions.select("tid", "item").distinct()
    names = [r["item"] for r in new.select("item").distinct().limit(2).collect()]
    if len(names) != 1 or a.transactions.where(F.col("item") == names[0]).limit(1).count():
        raise ValueError("one item that is new to the lattice")
    item = F.lit(names[0]).cast(a.transactions.schema["item"].dataType)
    every, all_values = a.transactions.unionByName(new), a.values.unionByName(values)
    support = new.count()
    alone = new.sparkSession.range(1).select(F.array(item).alias("items"), F.lit(support).cast("long").alias("support"))
    if support < a.least:
        return replace(a, transactions=every, values=all_values, low=a.low.unionByName(alone))
    among = cut(a.transactions.join(new.select("tid"), "tid", "left_semi"))
    maximal, infrequent = max_miner(among, a.least)
    with_item = F.sort_array(F.concat("items", F.array(item))).alias("items")
    found = members(lattice_nodes(maximal), among).select(with_item, "tid")
    added = cut(found.unionByName(new.select(F.array(item).alias("items"), "tid")))
    nodes = cut(a.nodes.unionByName(supports(added)))
    sums = cut(a.sums.unionByName(own_bins(supports(added), every, all_values, *a.bins)))
    above = lattice_edges(nodes).where(F.array_contains("parent", item))
    edges = cut(a.edges.unionByName(_weighed(above, sums, a.bins)))
    return Lattice(a.n, a.share, a.bins, every, all_values, nodes, a.low.unionByName(infrequent.select(with_item, "support")), cut(a.rows.unionByName(added)), sums, edges)
