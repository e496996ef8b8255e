"""Maximal frequent itemsets of any size, by a set-enumeration tree with look-ahead (Max-Miner), one level of the tree a round.

A group is a node of the tree: its head, and the tail of items that may still join it. What counts
its supports is the group's conditional table, the distinct remainders of the transactions that hold
the head, with their numbers; transactions with the same remainder are one row from then on. Every
round counts, for all groups at once, each head with one item of its tail, and the head with its
whole tail. If the whole is frequent, the subtree is closed at once. Else the tail is cut to its
frequent items, rarest first, and each of them heads a group of its own, with the items after it as
its tail. Where rows hold a fair share of the items, bitmaps count in place of the tables. Groups that lie inside a set found before are dropped by an index of the found sets by item.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from . import bitmaps


def least_count(transactions: DataFrame, share: float, rows: int | None = None) -> int:
    """The number of rows (of all transactions, unless given) that is ``share`` of them, one at least."""
    rows = transactions.select("tid").distinct().count() if rows is None else rows
    return max(1, -int(-share * rows // 1))


def inside(sets: DataFrame, found: DataFrame, strictly: bool = False) -> DataFrame:
    """Those of ``sets`` (items) that are a subset of one of ``found`` (items).

    Both sides meet at one item only: a set looks up the found sets that hold its rarest item there.
    """
    index = found.select(F.col("items").alias("outer"), F.explode("items").alias("item"))
    weight = index.groupBy("item").agg(F.count("*").alias("n"))
    wide = sets.select("items", F.explode("items").alias("item")).join(weight, "item", "left")
    rare = wide.groupBy("items").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "item")).alias("r")).where("r.n > 0").select("items", F.col("r.item").alias("item"))
    holds = F.size(F.array_except("items", "outer")) == 0
    if strictly:
        holds &= F.size("outer") > F.size("items")
    return rare.join(index, "item").where(holds).select("items").distinct()


def max_miner(transactions: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Maximal itemsets with support >= ``least``, and infrequent sets met on the way: both (items, support), items sorted.

    ``transactions`` is (tid, item); null items and repeats of an item in a transaction do not count.
    Ties in support go to the lower item. Without a frequent item both tables are empty of sets of one item or more.
    """
    names = bitmaps.dense_names(transactions, least)
    if names is not None:
        maps = bitmaps.bitmaps(transactions, names)
        sets, missed = _mined_in_bitmaps(maps, least)
        return tuple(df.select(maps.named("items").alias("items"), "support") for df in (sets, missed))
    distinct = transactions.where("item is not null").select("tid", "item").distinct()
    single = distinct.groupBy("item").agg(F.count("*").alias("support"))
    good = cut(single.where(F.col("support") >= least))
    none = F.array().cast(f"array<{transactions.schema['item'].dataType.simpleString()}>")
    rests = distinct.join(good.select("item"), "item", "left_semi").groupBy("tid").agg(F.sort_array(F.collect_set("item")).alias("rest"))
    rows = cut(rests.groupBy("rest").agg(F.count("*").alias("n")).select(none.alias("head"), "rest", "n"))
    groups = cut(good.agg(F.sort_array(F.collect_list("item")).alias("tail")).where(F.size("tail") > 0).select(none.alias("head"), F.lit(None).cast("long").alias("own"), "tail"))

    def counted(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        ones = held[0].select("head", "n", F.explode("rest").alias("item")).groupBy("head", "item").agg(F.sum("n").alias("support"))
        ahead = held[0].join(groups.select("head", F.size("tail").alias("size")), "head").groupBy("head").agg(F.sum(F.when(F.size("rest") == F.col("size"), F.col("n")).otherwise(0)).alias("whole"))
        return ones, ahead

    def narrowed(parted: DataFrame, groups: DataFrame) -> None:
        kept = held[0].join(parted.select("head", F.transform("order", lambda x: x["item"]).alias("order")), "head").select("head", "n", F.array_intersect("order", "rest").alias("rest"))
        parts = kept.select("head", "n", "rest", F.posexplode(F.slice("rest", F.lit(1), F.greatest(F.size("rest") - 1, F.lit(0)))).alias("k", "item"))
        parts = parts.select(F.concat("head", F.array("item")).alias("head"), F.slice("rest", F.col("k") + 2, F.size("rest")).alias("rest"), "n")
        held[0] = cut(parts.join(groups.select("head"), "head", "left_semi").groupBy("head", "rest").agg(F.sum("n").alias("n")))

    held = [rows]
    return _mined(groups, least, counted, narrowed)


def _mined_in_bitmaps(maps: bitmaps.Bitmaps, least: int) -> tuple[DataFrame, DataFrame]:
    none = F.array().cast("array<int>")
    singles = maps.table.sparkSession.range(len(maps.names)).select(none.alias("prefix"), F.col("id").cast("int").alias("x"))
    good = bitmaps.supports(maps, singles).where(F.col("support") >= least)
    groups = cut(good.agg(F.sort_array(F.collect_list("x")).alias("tail")).where(F.size("tail") > 0).select(none.alias("head"), F.lit(None).cast("long").alias("own"), "tail"))

    def counted(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        ones = bitmaps.supports(maps, groups.select(F.col("head").alias("prefix"), F.explode("tail").alias("x")))
        whole = groups.select("head", F.slice("tail", F.lit(1), F.size("tail") - 1).alias("more"), F.element_at("tail", -1).alias("x"))
        ahead = bitmaps.supports(maps, whole.select(F.concat("head", "more").alias("prefix"), "x")).withColumnRenamed("support", "whole")
        return ones.select(F.col("prefix").alias("head"), F.col("x").alias("item"), "support"), whole.select("head", F.concat("head", "more").alias("prefix"), "x").join(ahead, ["prefix", "x"]).select("head", "whole")

    return _mined(groups, least, counted, lambda parted, groups: None)


def _mined(groups: DataFrame, least: int, counted: Callable[[DataFrame], tuple[DataFrame, DataFrame]], narrowed: Callable[[DataFrame, DataFrame], None]) -> tuple[DataFrame, DataFrame]:
    """The search from the root group; ``counted`` gives (head, item, support) and (head, whole) of groups, ``narrowed`` is told which go on."""
    found: list[DataFrame] = []
    missed: list[DataFrame] = []
    while groups.count():
        ones, ahead = counted(groups)
        order = F.sort_array(F.collect_list(F.struct("support", "item")))
        frequent = ones.where(F.col("support") >= least).groupBy("head").agg(order.alias("order"))
        judged = cut(groups.join(frequent, "head", "left").join(ahead, "head", "left").withColumn("whole", F.coalesce("whole", F.lit(0).cast("long"))))
        closed = F.col("whole") >= least
        last = F.element_at("order", -1)
        ends = F.when(closed, F.struct(F.concat("head", "tail").alias("items"), F.col("whole").alias("support")))
        ends = ends.when(F.col("order").isNotNull(), F.struct(F.concat("head", F.array(last["item"])).alias("items"), last["support"].alias("support")))
        ends = ends.otherwise(F.struct(F.col("head").alias("items"), F.col("own").alias("support")))
        found.append(judged.select(ends.alias("e")).where(F.size("e.items") > 0).select(F.sort_array("e.items").alias("items"), "e.support"))
        missed.append(judged.where(~closed).select(F.sort_array(F.concat("head", "tail")).alias("items"), F.col("whole").alias("support")))
        parted = judged.where(~closed & (F.size("order") > 1))
        children = parted.select("head", F.posexplode(F.slice("order", F.lit(1), F.size("order") - 1)).alias("k", "one"), "order")
        tail = F.transform(F.slice("order", F.col("k") + 2, F.size("order")), lambda x: x["item"])
        children = children.select(F.concat("head", F.array("one.item")).alias("head"), F.col("one.support").alias("own"), tail.alias("tail"))
        whole = children.withColumn("items", F.sort_array(F.concat("head", "tail")))
        groups = cut(whole.join(inside(whole.select("items"), reduce(DataFrame.unionByName, found)), "items", "left_anti").drop("items"))
        narrowed(parted, groups)
    if not found:
        empty = groups.select(F.col("head").alias("items"), F.col("own").alias("support"))
        return empty, empty
    sets = cut(reduce(DataFrame.unionByName, found).distinct())
    return cut(sets.join(inside(sets.select("items"), sets, strictly=True), "items", "left_anti")), reduce(DataFrame.unionByName, missed).distinct()
