"""Quality rules: fixed base statistics and a learned decision list, as Spark expressions throughout.

Sequential covering learns the list from labelled statistics. Each statistic is cut halfway
between a few quantiles; the labelled rows are counted in Spark by the combination of their bins, and only
these counts reach the driver. A rule for low quality grows condition by condition (the one of
the highest information gain first) on two thirds of the rows and is pruned on the last third;
the rows it covers are taken out, and the next rule is sought. The list becomes one CASE
expression, so applying it is a projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statistics that rules may use.
FEATURES = ("symbols_per_word", "dup_line_share", "repeat_share", "word_length", "marks_per_word", "distinct_share", "words_per_line")
#: Quantiles, of the low-quality rows and of all, between which thresholds are tried.
CUTS = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: The decision list is fitted on at most so many labelled rows, those of the least hash of their id.
MAX_LABELLED = 40_000

_SPACE = r"[\\x20\\x09-\\x0D]+"
_REPEATED = """
transform(array(CASE WHEN size(w) >= 8 THEN transform(sequence(1, size(w) - 7), i -> xxhash64(slice(w, i, 8))) ELSE array() END), g ->
  CASE WHEN size(array_distinct(g)) = size(g) THEN 0 ELSE
    transform(array(sort_array(transform(g, (h, i) -> struct(h, i)))), s ->
      transform(array(sort_array(transform(filter(s, (x, k) -> x.h = get(s, k - 1).h OR x.h = get(s, k + 1).h), x -> x.i))), p ->
        aggregate(transform(p, (x, k) -> least(8, coalesce(get(p, k + 1) - x, 8))), 0, (a, b) -> a + b)
      )[0]
    )[0]
  END
)[0]
"""
_WORDS = f"""
transform(array(filter(split(text, '{_SPACE}'), x -> x <> '')), w ->
  struct(size(w) AS n_words, {_REPEATED} AS n_repeat_words, size(array_distinct(w)) AS n_distinct)
)[0]
"""
_LINES = r"""
transform(array(filter(split(text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')), l ->
  struct(size(l) AS n_lines, size(l) - size(array_distinct(l)) AS n_dup_lines)
)[0]
"""


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the text statistics of each row.

    Words are runs of characters other than space and control characters 9-13. n_words,
    word_chars (code points in words), n_symbols (characters of ``#*$%&|<>``), n_dup_lines (lines
    with a word that equal an earlier line), n_repeat_words (words inside 8-word windows that
    occur at least twice, the first occurrence included), base_failed (fewer than 20 words, or over
    30 in a hundred of them repeated); then the ratios in FEATURES. A null text has no words.
    """
    base = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumns({"w": F.expr(_WORDS), "l": F.expr(_LINES)})
    length = F.length("text")
    words = F.col("w.n_words")
    return base.select(
        "doc_id",
        words.cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.col("l.n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"),
        F.col("l.n_lines").cast("long").alias("n_lines"),
        F.col("w.n_distinct").cast("long").alias("n_distinct"),
        (length - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_marks"),
    ).withColumns(
        {
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "symbols_per_word": _ratio("n_symbols", "n_words"),
            "dup_line_share": _ratio("n_dup_lines", "n_lines"),
            "repeat_share": _ratio("n_repeat_words", "n_words"),
            "word_length": _ratio("word_chars", "n_words"),
            "marks_per_word": _ratio("n_marks", "n_words"),
            "distinct_share": _ratio("n_distinct", "n_words"),
            "words_per_line": _ratio("n_words", "n_lines"),
        }
    )


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def expression(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covers(bins: tuple, tests: list[tuple[int, bool, int]]) -> bool:
    return all((bins[f] > b) == above for f, above, b in tests)


def _gain(p0: float, n0: float, p1: float, n1: float) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def _grow(cells: list, n_bins: list[int]) -> list[tuple[int, bool, int]]:
    """Tests (feature, above, bin) in the order of their gain, until no counter-example is left or nothing gains."""
    tests: list[tuple[int, bool, int]] = []
    while len(tests) < 4:
        p0, n0 = sum(c[1] for c in cells), sum(c[2] for c in cells)
        if not p0 or not n0:
            break
        best = (0.0, None)
        for f, size in enumerate(n_bins):
            low, high = [0] * size, [0] * size
            for bins, p, n in cells:
                low[bins[f]] += p
                high[bins[f]] += n
            p = n = 0
            for b in range(size - 1):
                p, n = p + low[b], n + high[b]
                best = max(best, (_gain(p0, n0, p, n), (f, False, b)), (_gain(p0, n0, p0 - p, n0 - n), (f, True, b)), key=lambda x: x[0])
        if best[1] is None or best[0] < 1e-9:
            break
        tests.append(best[1])
        cells = [c for c in cells if _covers(c[0], [best[1]])]
    return tests


def learn_rules(stats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_rules: int = 10, least_precision: float = 0.6) -> list[Rule]:
    """A decision list for quality 0 from ``stats`` joined with ``labels`` (doc_id, quality 0 or 1).

    Unlabelled rows, null ids and null labels are not used. Without low-quality rows the list is
    empty. At most ``max_labelled`` rows are used; the driver sees counts of bin combinations only.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality")
    sample = stats.where("not base_failed").join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = sample.select("doc_id", "quality", *FEATURES)
    low = F.col("quality") == 0
    asked = [F.percentile_approx(F.when(low, F.col(f)), list(CUTS), 10_000).alias(f) for f in FEATURES] + [F.percentile_approx(f, list(CUTS), 10_000).alias(f"all_{f}") for f in FEATURES]
    found = sample.agg(*asked).first()
    if found[FEATURES[0]] is None:
        return []
    seen = {f: sorted({*found[f], *found[f"all_{f}"]}) for f in FEATURES}
    cuts = {f: [(a + b) / 2 for a, b in zip(seen[f], seen[f][1:])] for f in FEATURES}
    bins = [sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias(f) for f in FEATURES]
    prune = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    counts = sample.select(*bins, low.cast("int").alias("low"), prune.alias("prune")).groupBy(*FEATURES, "prune").agg(F.sum("low"), F.sum(1 - F.col("low"))).collect()
    n_bins = [len(cuts[f]) + 1 for f in FEATURES]
    grow = [(tuple(r[: len(FEATURES)]), r[-2], r[-1]) for r in counts if not r["prune"]]
    check = [(tuple(r[: len(FEATURES)]), r[-2], r[-1]) for r in counts if r["prune"]]
    rules: list[Rule] = []
    while len(rules) < max_rules:
        tests = _grow(grow, n_bins)
        if not tests:
            break
        worth = []
        for k in range(len(tests), 0, -1):
            p = sum(c[1] for c in check if _covers(c[0], tests[:k]))
            n = sum(c[2] for c in check if _covers(c[0], tests[:k]))
            worth.append(((p + 1) / (p + n + 2), k, p))
        precision, k, p = max(worth)
        if p == 0 or precision < least_precision:
            break
        tests = tests[:k]
        rules.append(tuple(Condition(FEATURES[f], above, cuts[FEATURES[f]][b]) for f, above, b in tests))
        grow = [c for c in grow if not _covers(c[0], tests)]
        check = [c for c in check if not _covers(c[0], tests)]
    return rules


def with_verdict(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule (the first that fires, as text; ``base`` for failed base checks; else null) and kept."""
    fired = F.when(F.col("base_failed"), F.lit("base"))
    for rule in rules:
        test = rule[0].expression()
        for condition in rule[1:]:
            test = test & condition.expression()
        fired = fired.when(test, F.lit(" and ".join(map(str, rule))))
    return stats.withColumn("rule", fired.otherwise(F.lit(None).cast("string"))).withColumn("kept", F.col("rule").isNull())
