"""Exact substring deduplication: word windows that occurred earlier in the corpus are cut out of the texts.

Every window of ``width`` consecutive words gets a Rabin-Karp hash, a polynomial over its words'
hashes that is read off a prefix sum. A task marks what it can tell by itself: a window that occurs
earlier among the windows it holds is surely a repeat. All others are counted in Spark: they are
dealt by hash, packed as arrays so that a window costs twelve bytes, and ranked by position among
the windows of their hash; all but the first are repeats. As a task sends one window of a hash at
most for each million that it reads, no hash is hot, however many copies there are. Repeats of a
document merge into maximal intervals of words, and the intervals are cut out of the text.

Two different windows share a 64-bit hash with a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ._scratch import Scratch, fresh, sized_join
from ._text import mix, pieces, powers, released, utf8, word_bounds, word_hashes

_U = np.uint64
#: Windows that a task holds before it deals them out.
_HELD = 1 << 20
_LEAST = -(1 << 63)
_PACKED = "bucket int, copy long, id_base long, start_base long, hashes array<long>, at array<int>"


def _window_hashes(h: np.ndarray, width: int, step: int = 1 << 18) -> Iterator[tuple[int, np.ndarray]]:
    """First place and hashes of the windows of ``width`` words, a bounded number at a time."""
    for at in range(0, h.size - width + 1, step):
        part = h[at : at + step + width - 1]
        n = part.size - width + 1
        up, down = powers(part.size)
        total = np.zeros(part.size + 1, dtype=_U)
        np.cumsum(part * up, out=total[1:])
        yield at, mix((total[width:] - total[:n]) * down[:n])


def _repeats(h: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows, sorted by position, share a hash with one at an earlier position; equal positions are not earlier."""
    by = np.argsort(h, kind="stable")
    new = np.ones(h.size, dtype=bool)
    new[1:] = h[by][1:] != h[by][:-1]
    lead = by[np.maximum.accumulate(np.where(new, np.arange(h.size), 0))]
    out = np.zeros(h.size, dtype=bool)
    out[by] = (ids[by] != ids[lead]) | (start[by] != start[lead])
    return out


def _pack(h: np.ndarray, ids: np.ndarray, copies: np.ndarray, start: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row for each bucket and block of 65,536 ids by 65,536 starts; a window that is surely a repeat has no hash and goes by its position."""
    if np.any(ids[1:] < ids[:-1]) or copies.any():
        by = np.lexsort((start, ids))
        h, ids, copies, start = h[by], ids[by], copies[by], start[by]
    sure = _repeats(h, ids, start)
    if copies.any():
        by = np.lexsort((start, ids, start >> 16, ids >> 16, copies))
        h, ids, copies, start, sure = h[by], ids[by], copies[by], start[by], sure[by]
    spread = np.where(sure, mix(ids.astype(_U) * _U(0x9E3779B97F4A7C15) + start.astype(_U)), h)
    bucket = ((spread >> _U(17)) % _U(parts)).astype(np.int64)
    high, far = ids >> 16, start >> 16
    new = np.ones(h.size, dtype=bool)
    new[1:] = (high[1:] != high[:-1]) | (far[1:] != far[:-1]) | (copies[1:] != copies[:-1])
    block = np.cumsum(new) - 1
    by = np.argsort(block * parts + bucket, kind="stable")
    cell = (block * parts + bucket)[by]
    firsts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    offsets = pa.array(np.append(firsts, h.size).astype(np.int32))
    lead = by[firsts]
    at = ((ids & 0xFFFF) << 16 | start & 0xFFFF).astype(np.uint32).view(np.int32)
    columns = [
        pa.array(bucket[lead].astype(np.int32)),
        pa.array(copies[lead]),
        pa.array(high[lead] << 16),
        pa.array(far[lead] << 16),
        pa.ListArray.from_arrays(offsets, pa.array(h[by].view(np.int64), mask=sure[by])),
        pa.ListArray.from_arrays(offsets, pa.array(at[by])),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "copy", "id_base", "start_base", "hashes", "at"])


def _packed(width: int, parts: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (id, copy, text) to packed windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, h, starts in word_hashes(batch.column(2), lower=False):
                row = np.repeat(np.arange(i, j), np.diff(starts))
                place = np.arange(h.size) - starts[row - i]
                whole = np.arange(h.size) + width <= starts[row - i + 1]
                for at, g in _window_hashes(h, width):
                    good = np.flatnonzero(whole[at : at + g.size])
                    if good.size:
                        held.append((g[good], ids[row[at + good]], copies[row[at + good]], place[at + good]))
                        n += good.size
                    if n >= _HELD:
                        yield _pack(*map(np.concatenate, zip(*held)), parts)
                        held, n = [], 0
        if n:
            yield _pack(*map(np.concatenate, zip(*held)), parts)

    return released(run)


def _with_identity(docs: DataFrame, names: tuple[str, str], scratch: Scratch) -> DataFrame:
    """Adds an id that is never null, and a copy number that tells texts of a repeated doc_id apart (0 elsewhere)."""
    own, copy = names
    docs = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)))
    again = scratch.keep(docs.groupBy(own).agg(F.count("*").alias("n")).where("n > 1").select(own, F.lit(True).alias(copy)), "again")
    rows = again.count()
    if not rows:
        return docs.withColumn(copy, F.lit(0).cast("long"))
    marked = sized_join(docs, again, own, "left", 32, rows)
    return marked.withColumn(copy, F.when(F.col(copy), F.xxhash64("text")).otherwise(F.lit(0).cast("long")))


def _merged(starts: Column, width: int) -> Column:
    """Maximal intervals (from, to) of words that the windows at these sorted places cover or touch."""
    first = F.filter(starts, lambda x, i: (i == 0) | (x - F.get(starts, i - 1) > width))
    last = F.filter(starts, lambda x, i: (i == F.size(starts) - 1) | (F.get(starts, i + 1) - x > width))
    return F.transform(F.arrays_zip(first.alias("a"), last.alias("z")), lambda s: F.struct(s["a"].alias("from"), (s["z"] + width).alias("to")))


def repeated_intervals(docs: DataFrame, width: int = 20, scratch: Scratch | None = None) -> DataFrame:
    """(id, copy, spans): for each document with repeats, its maximal intervals of words that are to go.

    ``docs`` has id (long), copy (long) and text; a document is an id and a copy. A document's
    intervals are one list, bounded by the words of its text.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("id", "copy", "text").mapInArrow(_packed(width, parts), _PACKED).repartitionById(parts, "bucket")
    flat = dealt.select("bucket", "copy", "id_base", "start_base", F.inline(F.arrays_zip("hashes", "at")))
    at = F.col("at")
    flat = flat.select("bucket", "hashes", "copy", (F.col("id_base") + F.shiftrightunsigned(at, 16)).alias("id"), (F.col("start_base") + at.bitwiseAND(0xFFFF)).cast("int").alias("start"))
    rank = F.rank().over(Window.partitionBy("hashes", "bucket").orderBy("id", "start"))
    again = flat.withColumn("rank", rank).where("hashes is null or rank > 1")
    lists = again.groupBy("id", "copy").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    return lists.select("id", "copy", _merged(F.col("starts"), width).alias("spans"))


def _cut(text: int, spans: int, keep: list[int], schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts the intervals of column ``spans`` out of column ``text``; appends the numbers of words and of removed words, and the intervals."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            gone = batch.column(spans)
            flat = gone.flatten()
            a, z = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            many = np.asarray(gone.value_lengths().fill_null(0))
            at = np.concatenate(([0], np.cumsum(many)))
            words, removed = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            texts: list[bytes | None] = []
            for i, j in pieces(offsets):
                b = data[offsets[i] : offsets[j]]
                cuts = offsets[i : j + 1] - offsets[i]
                s = word_bounds(b, cuts)[0] if b.size else np.zeros(0, np.int64)
                starts = np.searchsorted(s, cuts)
                words[i:j] = np.diff(starts)
                for row in range(i, j):
                    lo, hi = cuts[row - i], cuts[row - i + 1]
                    if not many[row]:
                        texts.append(b[lo:hi].tobytes())
                        continue
                    own = np.append(s[starts[row - i] : starts[row - i + 1]], hi)
                    froms, tos = a[at[row] : at[row + 1]], z[at[row] : at[row + 1]]
                    removed[row] = (tos - froms).sum()
                    texts.append(b"".join(b[x:y].tobytes() for x, y in zip([lo, *own[tos]], [*own[froms], hi])))
            null = batch.column(text).is_null().to_numpy(zero_copy_only=False)
            columns = [batch.column(k) for k in keep]
            columns[keep.index(text)] = pa.array([None if x else t for x, t in zip(null, texts)], pa.binary()).cast(schema.field(keep.index(text)).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words), pa.array(removed), gone], schema=schema)

    return released(run)


def without_repeated_windows(docs: DataFrame, width: int = 20, names: tuple[str, str, str] = ("n_words", "n_removed", "removed")) -> DataFrame:
    """``docs`` without the words of windows whose sequence of words also starts earlier; windows are judged on the input.

    A window is ``width`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one text, and earlier is a
    lesser doc_id, or the same doc_id and an earlier word. Adds n_words, n_removed (long) and
    removed, the intervals (from, to) of words cut out. A cut reaches from an interval's first word
    to the next word that stays, or to the end of the text.

    Defined cases: doc_id is an integer and a null one comes before all others; a null text stays
    null and has no words; texts with fewer words than ``width`` stay as they are; rows that share a
    doc_id are judged by where a window starts in them, equal starts leave both, so repeated rows
    lose the same words; texts of any length are taken whole, in bounded pieces; extra columns pass
    through, and no name of theirs can clash but those in ``names``, which may be chosen; an empty
    table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    own, copy, spans = fresh([*docs.columns, *names], "id", "copy", "spans")
    marked = _with_identity(docs, (own, copy), scratch)
    found = repeated_intervals(marked.select(F.col(own).alias("id"), F.col(copy).alias("copy"), "text"), width, scratch)
    found = scratch.keep(found.select(F.col("id").alias(own), F.col("copy").alias(copy), F.col("spans").alias(spans)), "spans")
    size = found.agg(F.sum(48 + 32 * F.size(spans))).first()[0] or 0
    joined = sized_join(marked, found, [own, copy], "left", 1, size).select(*docs.columns, spans)
    schema = joined.select(*docs.columns, F.lit(0).cast("long").alias(names[0]), F.lit(0).cast("long").alias(names[1]), F.col(spans).alias(names[2])).schema
    keep = list(range(len(docs.columns)))
    run = _cut(docs.columns.index("text"), len(docs.columns), keep, to_arrow_schema(schema))
    return joined.mapInArrow(run, schema)
