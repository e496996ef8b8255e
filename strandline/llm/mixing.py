"""Mixing sources to target weights by temperature, realised as budgeted permutations of blocks.

The token share p of every source is raised to an exponent a and normalised: a = 1 keeps the
corpus as it is, a = 0 weighs all sources alike. Bisection finds the exponent that meets a target
entropy, or the flattest mixture in which no source is repeated more often than allowed.

A source's quota of tokens is then filled in epochs. Each epoch is a permutation of the source's
blocks (documents are dealt to blocks by a hash of their id), and of the documents inside each
block, by hashes with the epoch in them. Whole blocks are taken while the quota lasts, and the
block that would exceed it is taken up to the document that reaches it. A source of n documents
has about as many blocks as the root of n, and a block as many documents: only block totals are
ordered across a source, and single documents only within one block, so no task orders more than
a few times the root of n rows.

Only Spark expressions are used. The driver sees two sums over all sources for each step of the
bisection, not the sources.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch, fresh, sized_join


#: Numbers of tokens that sources have, if so many at most, are added up by the driver.
FEW = 10_000


def mixture(shares: list[float], exponent: float) -> list[float]:
    """Weights proportional to share ** exponent; sources without tokens get none."""
    top = max((s for s in shares if s > 0), default=1.0)
    powered = [(s / top) ** exponent if s > 0 else 0.0 for s in shares]
    total = sum(powered)
    return [p / total if total else 0.0 for p in powered]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def solve_exponent(tokens: list[int], budget: float, target_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """``bisect`` for a list of token counts."""
    own = [t for t in tokens if t > 0]
    top = max(own, default=1)

    def sums(a: float) -> tuple[float, float]:
        powered = [(t / top) ** a for t in own]
        return sum(powered), sum(p * math.log(t / top) for p, t in zip(powered, own))

    return bisect(sums, min(own, default=0), top, budget, target_entropy, max_repeats)


def bisect(sums: Callable[[float], tuple[float, float]], least: int, most: int, budget: float, target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent in [0, 1] whose mixture has the target entropy, or the least one that repeats no source more than ``max_repeats`` times.

    sums gives, for an exponent a, the sum of r ** a over all sources and that of r ** a * log r,
    r being a source's tokens over those of the largest source. least and most: tokens of the
    smallest and the largest source. The smallest is repeated most often, at any exponent.
    Repetitions and entropy fall as the exponent rises, so bisection is exact to 2**-60. A target
    out of reach gives the nearer end.
    """
    if least <= 0:
        return 1.0

    def flat_enough(a: float) -> bool:
        total, logs = sums(a)
        if target_entropy is not None:
            return math.log(total) - a * logs / total <= target_entropy
        return (least / most) ** a / total * budget <= max_repeats * least * (1 + 1e-12)

    if flat_enough(0.0):
        return 0.0
    if not flat_enough(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (low, middle) if flat_enough(middle) else (middle, high)
    return high


def source_weights(totals: DataFrame, budget: int | None = None, target_entropy: float | None = None, max_repeats: float = 4.0) -> DataFrame:
    """One row per source: mix_source, tokens, weight, exponent, full (whole epochs), rest (tokens of a last, partial epoch) and bits (of a block's number).

    ``totals`` has the columns mix_source, tokens (above 0) and docs. Sources are put together by
    their number of tokens first; where that leaves few, the driver adds up their powers, else Spark.
    """
    spark = totals.sparkSession
    n, total, least, most = totals.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0)), F.min("tokens"), F.max("tokens")).first()
    if not n:
        return spark.createDataFrame([], "mix_source string, tokens long, weight double, exponent double, full long, rest long, bits int")
    budget = total if budget is None else budget
    alike = totals.groupBy("tokens").agg(F.count("*").alias("sources"))
    ratio = F.col("tokens") / F.lit(most)
    if alike.count() <= FEW:
        few = sorted((t, k) for t, k in alike.collect())

        def sums(a: float) -> tuple[float, float]:
            powered = [k * (t / most) ** a for t, k in few]
            return sum(powered), sum(p * math.log(t / most) for p, (t, _) in zip(powered, few))
    else:

        def sums(a: float) -> tuple[float, float]:
            powered = F.col("sources") * F.pow(ratio, F.lit(a))
            return tuple(alike.agg(F.sum(powered), F.sum(powered * F.log(ratio))).first())

    exponent = bisect(sums, least, most, budget, target_entropy, max_repeats)
    weight = F.pow(ratio, F.lit(exponent)) / F.lit(sums(exponent)[0])
    out = totals.withColumns({"weight": weight, "exponent": F.lit(exponent), "quota": F.round(weight * F.lit(budget)).cast("long")})
    bits = F.ceil(F.log2("docs") / 2).cast("int")
    return out.select("mix_source", "tokens", "weight", "exponent", F.expr("quota div tokens").alias("full"), F.expr("quota % tokens").alias("rest"), bits.alias("bits"))


def mix_sources(docs: DataFrame, budget: int | None = None, target_entropy: float | None = None, max_repeats: float = 4.0, seed: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` as often as the mixture takes each: its columns, mix_weight, mix_epoch, mix_place and mix_key.

    Tokens of a text are its words (runs of characters other than space and control characters
    9-13). ``budget`` is the number of tokens to emit, all of the corpus's by default. A source
    emits documents until its quota is reached, so it exceeds it by less than one document. The
    order of an epoch of a source is by mix_place (the block's) and mix_key (the document's).

    Defined cases: a null source is a source of its own; texts without words carry no tokens and
    are never emitted; rows that repeat doc_id and text are emitted together; rows without doc_id
    are dealt by their text; very long texts count all their words; documents whose keys tie are
    taken together; extra columns are carried along, but for those named like the four that are
    added; an empty table gives an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    source, row, block, full, whole, in_cut, bits = fresh([*docs.columns, "mix_weight", "mix_epoch", "mix_place", "mix_key"], "source_key", "row_key", "block", "full", "whole", "in_cut", "bits")
    text = F.col("text").cast("string")
    added = {source: F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")), row: F.xxhash64("doc_id", text, F.lit(seed))}
    words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    counted = docs.select(added[source].alias("mix_source"), added[row].alias("mix_row"), words.alias("mix_tokens"))
    counted = scratch.keep(counted.where("mix_tokens > 0"), "counted")
    totals = scratch.keep(counted.groupBy("mix_source").agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("docs")), "totals")
    weights = scratch.keep(source_weights(totals, budget, target_entropy, max_repeats), "weights")
    n_sources = weights.count()

    def numbered(row: Column, bits: Column) -> Column:
        """A block's number: the first bits of the row's hash."""
        return F.when(bits > 0, F.call_function("shiftrightunsigned", F.xxhash64(row, F.lit(seed)), F.lit(64) - bits)).otherwise(F.lit(0).cast("long"))

    partial = weights.where("rest > 0").select("mix_source", "full", "rest", "bits")
    placed = sized_join(counted, partial, "mix_source", "inner", 64, n_sources).withColumn("mix_block", numbered(F.col("mix_row"), F.col("bits")))
    blocks = placed.groupBy("mix_source", "mix_block", "full", "rest").agg(F.sum("mix_tokens").alias("in_block"))
    turn = Window.partitionBy("mix_source").orderBy(F.xxhash64("mix_block", "full", F.lit(seed)), "mix_block").rowsBetween(Window.unboundedPreceding, -1)
    plan = blocks.withColumn("left", F.col("rest") - F.coalesce(F.sum("in_block").over(turn), F.lit(0)))
    plan = scratch.keep(plan.where("left > 0").select("mix_source", "mix_block", "full", "left", (F.col("left") >= F.col("in_block")).alias("whole")), "plan")
    n_plan = plan.count()
    cut = sized_join(placed.drop("full"), plan.where("not whole"), ["mix_source", "mix_block"], "inner", 64, n_sources)
    cut = cut.groupBy("mix_source", "mix_block", "mix_row", "full", "left").agg(F.sum("mix_tokens").alias("mix_tokens"))
    inside = Window.partitionBy("mix_source", "mix_block").orderBy(F.xxhash64("mix_row", "full"), "mix_row").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("before", F.coalesce(F.sum("mix_tokens").over(inside), F.lit(0))).where("before < left")
    cut = scratch.keep(cut.select(F.col("mix_source").alias(source), F.col("mix_row").alias(row), F.lit(True).alias(in_cut)), "cut")
    out = docs.where(text.rlike(r"[^\x20\x09-\x0D]")).drop("mix_weight", "mix_epoch", "mix_place", "mix_key").withColumns(added)
    out = sized_join(out, weights.select(F.col("mix_source").alias(source), F.col("full").alias(full), F.col("weight").alias("mix_weight"), F.col("bits").alias(bits)), source, "left", 64, n_sources)
    out = out.withColumn(block, numbered(F.col(row), F.col(bits)))
    out = sized_join(out, plan.where("whole").select(F.col("mix_source").alias(source), F.col("mix_block").alias(block), F.col("whole").alias(whole)), [source, block], "left", 64, n_plan)
    out = sized_join(out, cut, [source, row], "left", 48, cut.count())
    extra = F.coalesce(F.col(whole), F.lit(False)) | F.coalesce(F.col(in_cut), F.lit(False))
    times = F.col(full) + extra.cast("long")
    out = out.where(times > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    out = out.withColumns({"mix_place": F.xxhash64(block, "mix_epoch", F.lit(seed)), "mix_key": F.xxhash64(row, "mix_epoch")})
    return out.drop(source, row, block, full, whole, in_cut, bits)
