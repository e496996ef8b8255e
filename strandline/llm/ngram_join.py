"""N-gram Jaccard join: documents whose sets of word shingles are similar, and their components.

Equal sets are one class. Classes are found by T-occurrence over an inverted index of shingles. A
set of n shingles shares at least T of them with a partner, and DivideSkip sets its T - 1 longest
lists aside: a partner reaches T - (T - 1) in the n - T + 1 short ones, those of the shingles that
are rarest in the corpus. So each class is posted in its short lists only, and who shares none with
it is no partner. List lengths come from one table of ``SLOTS`` counts over all documents, by a
hash of the shingle; any order that is the same for all sets loses nothing.

Lists become candidate clusters (``lists``), and these blocks of classes. Inside a
block the search is done with the block's own lists and DivideSkip's own number of long ones: a
heap merges the short, binary search probes the long, and who reaches the overlap is linked
(``blocks``). A class in no block has no partner, and its text is not read again.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch, fresh, sized_join
from ._text import mix, released, shingle_sets
from .blocks import MAX_ITEMS, resolve
from .lists import LONGEST, SPREAD, bitmaps, candidate_clusters

#: Counts of shingles by hash; a bounded table, whatever the corpus. They travel in pieces of CHUNK counts.
SLOTS = 1 << 20
CHUNK = 1 << 12
_SHIFT = np.uint64(64 - 20)
_U = np.uint64


def _keys(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two hashes of a set that is not empty; the first names its class."""
    return mix(s).sum(), mix(s ^ _U(0xA0761D6478BD642F)).sum()


def _sized(width: int) -> Callable:
    """mapInArrow function from (doc_id, text) to (doc_id, n_shingles, key1, key2, bits, chunk).

    Rows with a chunk are no documents: their bits hold counts of the task's shingles by slot.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        waiting: list[np.ndarray] = []
        names = ["doc_id", "n_shingles", "key1", "key2", "bits", "chunk"]

        def count() -> None:
            if waiting:
                maps.append(bitmaps(np.concatenate(waiting), np.array([s.size for s in waiting])))
                np.add(counts, np.bincount((np.concatenate(waiting) >> _SHIFT).astype(np.int64), minlength=SLOTS), out=counts)
                waiting.clear()

        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            keys = np.zeros((2, batch.num_rows), _U)
            maps: list[pa.Array] = []
            size = 0
            for row, s in shingle_sets(batch.column("text"), width):
                n[row] = s.size
                if s.size:
                    keys[:, row] = _keys(s)
                    waiting.append(s)
                    size += s.size
                    if size > 1 << 18:
                        count()
                        size = 0
            count()
            bits = pa.concat_arrays(maps).take(pa.array(np.where(n > 0, np.cumsum(n > 0) - 1, 0), mask=n == 0)) if maps else pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), bits, pa.nulls(batch.num_rows, pa.int32())], names)
        pieces = counts.reshape(-1, CHUNK)
        full = np.flatnonzero(pieces.any(axis=1))
        none = pa.nulls(full.size, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([zlib.compress(pieces[k].tobytes(), 1) for k in full], pa.binary()), pa.array(full.astype(np.int32))], names)

    return released(run)


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pieces (chunk, bits), sorted by chunk."""
    own, total = None, np.zeros(CHUNK, np.int64)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["chunk", "bits"])

    for batch in batches:
        for chunk, bits in zip(batch.column("chunk").to_pylist(), batch.column("bits").to_pylist()):
            if chunk != own:
                if own is not None:
                    yield row()
                own, total = chunk, np.zeros(CHUNK, np.int64)
            total += np.frombuffer(zlib.decompress(bits), np.int64)
    if own is not None:
        yield row()


def _frequencies(sized: DataFrame) -> tuple[bytes, int]:
    """The table of counts, compressed, and their sum. The driver sees ``SLOTS`` numbers."""
    pieces = sized.where("chunk is not null").select("chunk", "bits").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_summed, "chunk int, bits binary").collect()
    table = np.zeros((SLOTS // CHUNK, CHUNK), np.int64)
    for chunk, bits in pieces:
        table[chunk] = np.frombuffer(zlib.decompress(bits), np.int64)
    return zlib.compress(table.tobytes(), 1), int(table.sum())


@lru_cache(maxsize=2)
def _table(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.int64)


def rarest(s: np.ndarray, percent: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a sorted set's short lists, and the lengths that the table tells.

    A set that has no partner but itself, at its size, has none.
    """
    need = -(-percent * s.size // 100)
    if need == s.size and s.size * 100 // percent == s.size:
        return s[:0], table[:0]
    length = table[(s >> _SHIFT).astype(np.int64)]
    order = np.argsort(length, kind="stable")[: s.size - need + 1]
    return s[order], length[order]


def _posted(width: int, percent: int, packed: bytes, hot: int) -> Callable:
    """mapInArrow function from texts to postings (list, spread, id); equal sets are posted once a task as far as it remembers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(packed)
        seen: set[int] = set()

        def rows(parts: list[tuple[np.uint64, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            lists = np.concatenate([p[1] for p in parts])
            length = np.concatenate([p[2] for p in parts])
            ids = np.repeat(np.array([p[0] for p in parts], _U), [p[1].size for p in parts])
            spread = np.where(length > hot, (ids % _U(SPREAD)).astype(np.int64) + 1, 0)
            return pa.RecordBatch.from_arrays([pa.array(lists.view(np.int64)), pa.array(spread), pa.array(ids.view(np.int64))], ["list", "spread", "id"])

        for batch in batches:
            parts, size = [], 0
            for _, s in shingle_sets(batch.column("text"), width):
                if not s.size:
                    continue
                key = _keys(s)[0]
                if int(key) in seen:
                    continue
                if len(seen) > 1 << 20:
                    seen.clear()
                seen.add(int(key))
                lists, length = rarest(s, percent, table)
                if lists.size:
                    parts.append((key, lists, length))
                    size += lists.size
                    if size > 200_000:
                        yield rows(parts)
                        parts, size = [], 0
            if parts:
                yield rows(parts)

    return released(run)


def _sets(width: int) -> Callable:
    """Shingle sets of texts, and their class ids."""

    def make(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        sets = [s for _, s in shingle_sets(texts, width)]
        return sets, np.array([_keys(s)[0] if s.size else 0 for s in sets], dtype=_U).view(np.int64)

    return make


def ngram_jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, scratch: Scratch | None = None, max_items: int = MAX_ITEMS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles (size of its shingle set), component_id.

    Words are runs of characters other than space and control characters 9-13 of the text with
    A-Z lower-cased. Two rows link when the Jaccard similarity of their shingle sets is at least
    ``percent`` in a hundred; component_id is the least doc_id reachable by links, the own one
    included. A text with fewer words than ``width`` has its whole sequence as its one shingle.

    Defined cases: a null or wordless text has an empty set and is linked with nothing; repeated
    rows are returned each, and link by their texts, as do different texts of one doc_id; a row
    without doc_id is linked with equal sets but never names a component (null where no row of its
    set has a doc_id); columns other than doc_id and text are not read; an empty table gives an
    empty table. Sets are told apart by 64-bit hashes.
    """
    scratch = scratch or Scratch(docs.sparkSession, "ngram")
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = scratch.keep(base.mapInArrow(_sized(width), "doc_id long, n_shingles long, key1 long, key2 long, bits binary, chunk int"), "sizes")
    sized = pieces.where("chunk is null").select("doc_id", "n_shingles", "key1", "key2")
    packed, total = _frequencies(pieces)
    posted = base.select("text").mapInArrow(_posted(width, percent, packed, max(LONGEST, total >> 16)), "list long, spread long, id long")
    bits = pieces.where("chunk is null and n_shingles > 0").select(F.col("key1").alias("id"), F.col("n_shingles").alias("n"), "bits")
    pairs = candidate_clusters(posted, bits, percent, scratch)
    classes = scratch.keep(sized.where("n_shingles > 0").groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    named = classes.where("rep is not null").select(F.col("rep").alias("doc_id"), F.col("key1").alias("id"))
    texts = base.where("doc_id is not null")

    def fetch(members: DataFrame, n: int) -> DataFrame:
        placed = sized_join(named, members, "id", "inner", 64, n)
        return sized_join(texts, placed, "doc_id", "inner", 80, n).withColumnRenamed("text", "payload").drop("doc_id")

    found = scratch.keep(resolve(pairs, fetch, _sets(width), percent, scratch, max_items).withColumnRenamed("id", "key1"), "found")
    scratch.clear(pieces, classes, found)
    linked = classes.join(found, "key1", "left").withColumn("component", F.coalesce("component", "key1"))
    least = linked.join(found.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("rep").alias("least"))
    ids = linked.join(least, "component", "left").select("key1", "key2", "n_shingles", F.coalesce("least", "rep").alias("component_id"))
    labelled = sized.where("n_shingles > 0").join(ids, ["key1", "key2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    alone = sized.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return labelled.unionByName(alone)


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; columns stay as they are.

    Rows that repeat a doc_id and its text stay once (any one of them, if other columns differ). Different texts of one doc_id stay together,
    or go together if one of them is linked with a smaller doc_id. Rows without doc_id stay.
    """
    scratch = Scratch(docs.sparkSession, "one")
    inner = Scratch(docs.sparkSession, "ngram")
    labels = scratch.keep(ngram_jaccard_components(docs, width, percent, inner), "labels")
    inner.clear()
    lost = scratch.keep(labels.where("component_id <> doc_id").select("doc_id").distinct(), "lost")
    kept = sized_join(docs, lost, "doc_id", "left_anti", 16, lost.count())
    twice = scratch.keep(labels.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    n = twice.count()
    if not n:
        return kept.select(*docs.columns)
    (turn,) = fresh(docs.columns, "turn")
    some = sized_join(kept, twice, "doc_id", "left_semi", 16, n).withColumn(turn, F.xxhash64("text"))
    some = some.dropDuplicates(["doc_id", turn]).select(*docs.columns)
    return sized_join(kept, twice, "doc_id", "left_anti", 16, n).select(*docs.columns).unionByName(some)
