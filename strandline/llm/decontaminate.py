"""Benchmark decontamination: test items inside documents, by size-partitioned MinHash containment search.

An item counts as contained in a document when at least ``percent`` in a hundred of its word
shingles occur there. Items are partitioned by the number of their shingles (powers of two). The
sketch of an item is its ``SKETCH`` least shingle hashes, so an item of any size costs the same,
and each partition has a greatest sketch value that falls as its items grow: a document probes a
partition only with shingles of at most that value, and only partitions whose items are small
enough to be contained. Whoever holds ``percent`` of an item's shingles holds none of its sketch
with a probability of at most (1 - percent / 100) ** SKETCH; a verbatim copy is never missed.
Candidates are then verified by the exact share of the item's shingles.

Only Spark expressions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch, fresh, sized_join

SKETCH = 6


def _shingled(texts: DataFrame, width: int) -> DataFrame:
    """Replaces the column text by shingles: distinct hashes of ``width`` successive words.

    Words are runs of letters and digits in lower case. A text of fewer words has its whole
    sequence as one shingle, marked by its length; a text without words has none.
    """
    words = r"filter(split(lower(text), '[^\\p{L}\\p{N}]+'), x -> x <> '')"
    shingles = f"""
    transform(array({words}), w ->
      CASE WHEN size(w) >= {width} THEN array_distinct(transform(sequence(1, size(w) - {width - 1}), i -> xxhash64(slice(w, i, {width}))))
           WHEN size(w) > 0 THEN array(xxhash64(w, size(w)))
           ELSE array() END
    )[0]
    """
    return texts.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("shingles", F.expr(shingles)).drop("text")


def contained_items(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80, sketch: int = SKETCH, scratch: Scratch | None = None) -> DataFrame:
    """Rows (doc_id, item_id, n_item, n_common, containment, text_key), one for each row of ``docs`` and item it contains.

    n_item is the item's number of distinct shingles, n_common how many of them the document has;
    text_key is xxhash64 of the document's text.

    Defined cases: null and wordless texts contain nothing and are contained in nothing; an item
    of fewer than ``width`` words is contained only in a text of just these words; repeated items
    are reported once for each item_id, a null item_id like any other; rows that repeat a document
    are reported each; other columns are not read; empty tables give an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession, "leaks")
    items = benchmark.select("item_id", "text").distinct()
    items = _shingled(items, width).where("size(shingles) > 0").withColumn("n_item", F.size("shingles").cast("long"))
    items = items.withColumn("partition", F.floor(F.log2("n_item")).cast("int")).withColumn("sketch", F.slice(F.sort_array("shingles"), 1, sketch))
    items = scratch.keep(items.withColumn("item_key", F.xxhash64("item_id", "shingles")), "items")
    n_items, n_shingles = items.agg(F.count("*"), F.coalesce(F.sum("n_item"), F.lit(0))).first()
    limits = items.groupBy("partition").agg(F.max(F.array_max("sketch")).alias("top"), F.min("n_item").alias("least")).orderBy("partition").collect()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    rule = " OR ".join(f"(h <= {r['top']}L AND size(shingles) * 100L >= {percent * r['least']}L)" for r in limits) or "false"
    probes = _shingled(texts.drop("doc_id"), width).select("text_key", F.explode(F.expr(f"filter(shingles, h -> {rule})")).alias("h"))
    sketches = items.select("item_key", F.explode("sketch").alias("h"))
    found = sized_join(probes, sketches, "h", "inner", 16, n_items * sketch).select("text_key", "item_key").distinct()
    candidates = scratch.keep(found.groupBy("text_key").agg(F.collect_set("item_key").alias("item_keys")), "candidates")
    n, pairs = candidates.agg(F.count("*"), F.coalesce(F.sum(F.size("item_keys")), F.lit(0))).first()
    held = _shingled(sized_join(texts, candidates, "text_key", "inner", 1, 32 * n + 8 * pairs), width)
    held = held.select("doc_id", "text_key", "shingles", F.explode("item_keys").alias("item_key"))
    wanted = items.select("item_key", "item_id", "n_item", F.col("shingles").alias("item_shingles"))
    held = sized_join(held, wanted, "item_key", "inner", 1, 40 * n_items + 8 * n_shingles)
    held = held.withColumn("n_common", F.size(F.array_intersect("item_shingles", "shingles")).cast("long")).where(f"100 * n_common >= {percent} * n_item")
    return held.select("doc_id", "item_id", "n_item", "n_common", (F.col("n_common") / F.col("n_item")).alias("containment"), "text_key")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose text contains an item; all their columns stay as they are."""
    scratch = Scratch(docs.sparkSession, "clean")
    (key,) = fresh(docs.columns, "key")
    bad = scratch.keep(contained_items(docs, benchmark, width, percent, scratch=scratch).select(F.col("text_key").alias(key)).distinct(), "contaminated")
    return sized_join(docs.withColumn(key, F.xxhash64(F.col("text").cast("string"))), bad, key, "left_anti", 16, bad.count()).select(*docs.columns)
