"""Formal concepts (closed itemsets with their supports) by close-by-one, a level of the enumeration a round.

A concept's intent is the set of items that all its rows have. It is extended by each item that comes
after the one it was made with; the rows that have the item too give the new intent. The extension
is canonical if that adds no item before the one it was extended by, and then it is kept. Every
concept has one canonical extension that makes it, so none is made twice and no table of the concepts
found before is asked.

Sets are words of bits, and the intent common to rows is one bit_and of their words, which Spark
adds up where the rows are. Rows with the same items are one row with a number; where most rows differ,
bitmaps of the items count in their place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from . import bitmaps

_BITS = 60
#: Different rows that each round reads; of more, bitmaps are made.
PATTERNS = 1 << 12


def _below(core: Column, word: int) -> Column:
    """Bits of a word that stand for items before ``core``."""
    n = F.least(F.greatest(core - word * _BITS, F.lit(0)), F.lit(_BITS)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1


def _places(bits: Column, word: int) -> Column:
    """Numbers of the items whose bits are set in a word."""
    return F.filter(F.sequence(F.lit(word * _BITS), F.lit((word + 1) * _BITS - 1)), lambda k: F.getbit(bits, k % _BITS) == 1)


def formal_concepts(transactions: DataFrame, least: int = 1) -> DataFrame:
    """(items, support): every set of items that is all that its rows have in common, with at least ``least`` rows.

    ``transactions`` is (tid, item); items are ordered by their values. The set common to all rows
    belongs to the result, even if it is empty; rows without any item are not in the table and do
    not count. Null items are left out. The items are the columns of the context, so the driver
    names them; rows and concepts stay in Spark.
    """
    distinct = transactions.where("item is not null").select("tid", "item")
    # Repeats of an item in a row set a bit again; an item that only repeats make frequent is in no concept of enough rows.
    names = [r["item"] for r in distinct.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy("item").collect()]
    kind = transactions.schema["item"].dataType
    spark = transactions.sparkSession
    words = max(1, -(-len(names) // _BITS))
    place = spark.createDataFrame([(x, k) for k, x in enumerate(names)], f"item {kind.simpleString()}, k int")
    own, seen, new = ([f"{c}{w}" for w in range(words)] for c in ("p", "b", "c"))
    bits = [F.coalesce(F.bit_or(F.when(F.floor(F.col("k") / _BITS) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("k") % _BITS).cast("int")))), F.lit(0).cast("long")).alias(own[w]) for w in range(words)]
    patterns = cut(distinct.join(F.broadcast(place), "item", "left").groupBy("tid").agg(*bits).groupBy(*own).agg(F.count("*").alias("n")))
    if patterns.limit(PATTERNS + 1).count() > PATTERNS and (dense := bitmaps.dense_names(transactions, least)) is not None:
        return _concepts_in_bitmaps(bitmaps.bitmaps(transactions, dense), least)
    whole = [F.bit_and(p).alias(b) for p, b in zip(own, seen)]
    level = cut(patterns.agg(*whole, F.sum("n").alias("support")).where(F.col("support") >= least))
    rows = patterns.crossJoin(level.drop("support")).withColumn("core", F.lit(-1))
    found = []
    while level.count():
        found.append(level.select(*seen, "support"))
        free = [F.col(p).bitwiseAND(F.bitwise_not(_below(F.col("core") + 1, w))).bitwiseAND(F.bitwise_not(F.col(b))) for w, (p, b) in enumerate(zip(own, seen))]
        items = F.concat(*(_places(f, w) for w, f in enumerate(free)))
        wide = rows.select(*seen, *own, "n", F.explode(items).alias("j"))
        closed = wide.groupBy(*seen, "j").agg(*(F.bit_and(p).alias(c) for p, c in zip(own, new)), F.sum("n").alias("support")).where(F.col("support") >= least)
        for w in range(words):
            mask = _below(F.col("j"), w)
            closed = closed.where(F.col(new[w]).bitwiseAND(mask) == F.col(seen[w]).bitwiseAND(mask))
        closed = cut(closed)
        level = closed.select(*(F.col(c).alias(b) for c, b in zip(new, seen)), "support")
        rows = cut(wide.join(closed.drop("support"), [*seen, "j"]).select(*(F.col(c).alias(b) for c, b in zip(new, seen)), *own, "n", F.col("j").alias("core")))
    if not found:
        return spark.createDataFrame([], f"items array<{kind.simpleString()}>, support long")
    concepts = reduce(DataFrame.unionByName, found)
    named = F.array(*(F.when(F.getbit(seen[k // _BITS], F.lit(k % _BITS)) == 1, F.lit(x)) for k, x in enumerate(names))).cast(f"array<{kind.simpleString()}>")
    return concepts.select(F.array_compact(named).alias("items"), "support")


def _concepts_in_bitmaps(maps: bitmaps.Bitmaps, least: int) -> DataFrame:
    every = F.array(*map(F.lit, range(len(maps.names)))).cast("array<int>")

    def closed(sets: DataFrame) -> DataFrame:
        good = cut(bitmaps.supports(maps, sets).where(F.col("support") >= least))
        new = bitmaps.closures(maps, good).join(good, ["prefix", "x"])
        canonical = F.forall("items", lambda i: (F.col("x") < 0) | (i >= F.col("x")) | F.array_contains("prefix", i))
        return cut(new.where(canonical).select("items", F.col("x").alias("core"), "support"))

    level = closed(maps.table.sparkSession.range(1).select(F.array().cast("array<int>").alias("prefix"), F.lit(-1).alias("x")))
    found = [level]
    while level.count():
        free = F.filter(every, lambda j: (j > F.col("core")) & ~F.array_contains("items", j))
        level = closed(level.select(F.col("items").alias("prefix"), F.explode(free).alias("x")))
        found.append(level)
    return reduce(DataFrame.unionByName, found).select(maps.named("items").alias("items"), "support")
