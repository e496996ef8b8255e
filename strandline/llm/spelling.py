"""Spelling variants: words of a corpus that differ by one edit, found by blocked Gram matrices.

Words are counted where texts are read and the counts added in Spark. A word's letter counts are a
vector; one replaced letter moves it by a squared distance of two at most, one inserted or deleted
letter by one. The letters are dealt to a few groups of about equal weight, and the words with the
same number of letters of each group, and so of one length, make a cell, which is cut into blocks.
An edit leads to the same cell or to a cell next to it, of the same or an adjacent length. Each pair
of blocks from such cells is a row of its own, so no cell is too large for a task: NumPy multiplies
the blocks' count matrices, squared distances follow from the product and the norms, pairs at most
two apart are kept, and edits decide.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch, sized_join
from ._text import bounds, lowered, pieces, released, run_hashes, utf8

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PIECE = 1 << 20
#: Distinct words that a task holds before it hands their counts on.
_HELD = 1 << 18
#: Words of a block, and code points of its words together.
_BLOCK, _BLOCK_CHARS = 1024, 1 << 18
#: Groups of letters.
GROUPS = 6
#: Place of each Latin-1 letter in a count vector: a-z, then U+00C0 to U+00FF.
_PLACE = np.zeros(256, dtype=np.int64)
_PLACE[97:123] = np.arange(26)
_PLACE[0xC0:] = 26 + np.arange(64)
_PLACES = 90


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _letters(b: np.ndarray) -> np.ndarray:
    """Which bytes belong to a letter A-Z, a-z or U+00C0 to U+00FF, which in UTF-8 is 0xC3 and one more byte."""
    lead = b == 0xC3
    inside = _LETTER[b] | lead
    inside[1:] |= lead[:-1]
    return inside


def _crc32(b: np.ndarray, s: np.ndarray, e: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC32 of the runs of b from s to e, each carried on from a CRC32; long runs one by one, the others a byte of all at a time."""
    out = state.astype(np.uint32)
    size = e - s
    for k in np.flatnonzero(size > 64):
        out[k] = zlib.crc32(b[s[k] : e[k]].tobytes(), int(out[k]))
    live = np.flatnonzero(size <= 64)
    now = ~out[live]
    for k in range(int(size[live].max()) if live.size else 0):
        on = size[live] > k
        if not on.all():
            out[live[~on]] = ~now[~on]
            live, now = live[on], now[on]
        now = _CRC[(now ^ b[s[live] + k]) & 0xFF] ^ now >> np.uint32(8)
    out[live] = ~now
    return out


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row of runs of texts, their bytes and cuts; a very long text comes in several pieces that end outside letters."""
    for i, j in pieces(offsets):
        b, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if j > i + 1 or b.size <= 2 * _PIECE:
            yield i, j, b, cuts
            continue
        at = 0
        while at < b.size:
            end = min(at + _PIECE, b.size)
            while end < b.size:
                gap = np.flatnonzero(~_letters(b[end : end + _PIECE])[1:])
                if gap.size:
                    end += 1 + int(gap[0])
                    break
                end = min(end + _PIECE, b.size)
            yield i, j, b[at:end], np.array([0, end - at])
            at = end


def _typed(least: int, every: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (doc_id as text, text) to (word, n): counts of a task's words, one code point gone where CRC32 says so."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def counted() -> pa.RecordBatch:
            words = pa.array(list(found.keys()), pa.binary()).cast(pa.string())
            batch = pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, b, cuts in _parts(*utf8(batch.column(1))):
                if not b.size:
                    continue
                s, e = bounds(_letters(b), cuts)
                b = lowered(b)
                chars = np.zeros(b.size + 1, dtype=np.int64)
                np.cumsum((b & 0xC0) != 0x80, out=chars[1:])
                long = chars[e] - chars[s] >= least
                s, e = s[long], e[long]
                row = np.searchsorted(cuts, s, side="right") - 1
                whole = np.ones(s.size, dtype=bool)
                if every:
                    seeds = np.array([zlib.crc32(f"{x}:".encode()) if x is not None else 0 for x in ids[i:j]], dtype=np.uint32)
                    known = np.array([x is not None for x in ids[i:j]], dtype=bool)
                    h = _crc32(b, s, e, seeds[row])
                    whole = (h % every != 0) | ~known[row]
                    for k in np.flatnonzero(~whole):
                        word = b[s[k] : e[k]].tobytes().decode()
                        at = int(h[k]) % len(word)
                        if len(word) > least:
                            found[(word[:at] + word[at + 1 :]).encode()] += 1
                s, e = s[whole], e[whole]
                _, first, n = np.unique(run_hashes(b, s, e), return_index=True, return_counts=True)
                for x, y, k in zip(s[first].tolist(), e[first].tolist(), n.tolist()):
                    found[b[x:y].tobytes()] += k
                if len(found) >= _HELD:
                    yield counted()
        if found:
            yield counted()

    return released(run)


def count_words(docs: DataFrame, least_chars: int = 5, least_n: int = 3, drop_every: int = 0) -> DataFrame:
    """(word, n): maximal runs of letters of all texts, A-Z lower-cased, of at least ``least_chars`` code points and ``least_n`` occurrences.

    With ``drop_every``, a run whose CRC32 of ``<doc_id>:<run>`` it divides loses one code point, the
    CRC32's remainder by the run's length; runs of a null doc_id lose none.
    """
    found = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(_typed(least_chars, drop_every), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _groups(words: DataFrame, groups: int) -> list[str]:
    """The letters of the words in groups of about equal numbers of occurrences, the commonest letters dealt first."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n")).collect()
    out, weight = [""] * groups, [0] * groups
    for r in sorted(letters, key=lambda r: (-r["n"], r["c"])):
        k = weight.index(min(weight))
        out[k] += r["c"]
        weight[k] += r["n"]
    return out


def _edits(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows of code points differ by one replacement (same length) or one code point more in b."""
    size = a.shape[1]
    if size == b.shape[1]:
        return (a[i] != b[j]).sum(axis=1) == 1
    end = np.zeros((i.size, 1), dtype=bool)
    front = np.argmin(np.concatenate((a[i] == b[j][:, :size], end), axis=1), axis=1)
    back = np.argmin(np.concatenate((a[i][:, ::-1] == b[j][:, :0:-1], end), axis=1), axis=1)
    return front + back >= size


def _counts(codes: np.ndarray) -> np.ndarray:
    """Letter counts of rows of Latin-1 code points, in a type that holds sums of squares of the row length exactly."""
    rows, size = codes.shape
    flat = (np.arange(rows)[:, None] * _PLACES + _PLACE[codes]).ravel()
    kind = np.float32 if size < 2000 else np.float64
    return np.bincount(flat, minlength=rows * _PLACES).reshape(rows, _PLACES).astype(kind)


def _near(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows one edit apart: the Gram matrix of letter counts keeps those at a squared distance of two at most, edits decide."""
    x, y = _counts(a), _counts(b)
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero(d <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    step = max(1, (1 << 22) // a.shape[1])
    good = [_edits(a, b, i[k : k + step], j[k : k + step]) for k in range(0, i.size, step)]
    good = np.concatenate(good) if good else np.zeros(0, dtype=bool)
    return i[good], j[good]


def _best(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each i: its first partner by falling n, then place (blocks are in code-point order), and the number of partners."""
    by = np.lexsort((j, -n[j], i))
    i, j = i[by], j[by]
    first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
    return i[first], j[first], np.diff(np.append(first, i.size))


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pairs of blocks (words strung together, their length and counts) to (word, near, near_n, n_near) of the pair."""
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            a, b = (np.frombuffer(r[f"{k}_words"].encode("latin-1"), np.uint8).reshape(-1, r[f"{k}_size"]) for k in "ab")
            n_a, n_b = np.array(r["a_n"]), np.array(r["b_n"])
            i, j = _near(a, b, r["same"])
            if not i.size:
                continue
            for x, y, n, u, v in ((i, j, n_b, a, b), (j, i, n_a, b, a)):
                for p, q, k in zip(*_best(x, y, n)):
                    out.append((u[p].tobytes().decode("latin-1"), v[q].tobytes().decode("latin-1"), int(n[q]), int(k)))
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["word", "near", "near_n", "n_near"])


def near_words(words: DataFrame, scratch: Scratch, groups: int = GROUPS) -> DataFrame:
    """(word, near, near_n, n_near): for words (word, n) with a word one edit away, the nearest of the largest n (then the least), and their number."""
    parts = _groups(words, groups)
    cell = F.array(*(F.length("word") - F.length(F.translate("word", p, "")) for p in parts))
    celled = words.withColumn("cell", cell)
    share = F.greatest(F.ceil(F.col("n_words") / F.lit(_BLOCK)), F.ceil(F.col("n_words") * F.col("size") / F.lit(_BLOCK_CHARS)))
    cells = celled.groupBy("cell").agg(F.count("*").alias("n_words"), F.max(F.length("word")).alias("size")).select("cell", share.cast("int").alias("chunks"))
    cells = scratch.keep(cells, "cells")
    dealt = celled.join(cells, "cell").withColumn("chunk", F.pmod(F.xxhash64("word"), "chunks").cast("int"))
    rows = F.sort_array(F.collect_list(F.struct("word", "n")))
    blocks = dealt.groupBy("cell", "chunk", "chunks").agg(rows.alias("rows"), F.max(F.length("word")).alias("size"))
    blocks = blocks.select("cell", "chunk", "size", F.array_join(F.transform("rows", lambda r: r["word"]), "").alias("words"), F.transform("rows", lambda r: r["n"]).alias("n"))
    blocks = scratch.keep(blocks, "blocks")
    still = [0] * groups
    steps = [still] + [[int(k == i) for k in range(groups)] for i in range(groups)]
    steps += [[int(k == j) - int(k == i) for k in range(groups)] for i in range(groups) for j in range(i + 1, groups)]
    step = F.explode(F.array(*(F.array(*map(F.lit, s)) for s in steps)))
    keys = blocks.select(F.col("cell").alias("a_cell"), F.col("chunk").alias("a_chunk"), step.alias("step"))
    keys = keys.select("a_cell", "a_chunk", F.zip_with("a_cell", "step", lambda x, y: x + y).alias("b_cell"))
    keys = keys.join(cells.select(F.col("cell").alias("b_cell"), "chunks"), "b_cell")
    pairs = keys.withColumn("b_chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("a_cell <> b_cell or b_chunk <= a_chunk")
    pairs = pairs.withColumn("same", F.expr("a_cell = b_cell and a_chunk = b_chunk"))
    side = {k: blocks.select(*(F.col(c).alias(f"{k}_{c}") for c in blocks.columns)) for k in "ab"}
    both = pairs.join(side["a"], ["a_cell", "a_chunk"]).join(side["b"], ["b_cell", "b_chunk"])
    both = both.select("same", "a_words", "a_size", "a_n", "b_words", "b_size", "b_n")
    found = both.mapInArrow(released(_compare), "word string, near string, near_n long, n_near long")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    out = found.groupBy("word").agg(best.alias("best"), F.sum("n_near").alias("n_near"))
    return out.select("word", "best.near", (-F.col("best.m")).alias("near_n"), "n_near")


def _roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) from (word, form) by pointer doubling; a form has twice its word's n, so chains are shorter than 64."""
    up = scratch.keep(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        hops = scratch.keep(up.join(up.select(F.col("root").alias("word")).distinct(), "word", "left_semi").select(F.col("word").alias("root"), F.col("root").alias("above")), "hops")
        rows, size = hops.agg(F.count("*"), F.sum(64 + 2 * F.length("root") + 2 * F.length("above"))).first()
        if not rows:
            return up
        up = scratch.keep(sized_join(up, hops, "root", "left", 1, size).select("word", F.coalesce("above", "root").alias("root")), "roots")


def spelling_variants(words: DataFrame, ratio: int = 2, groups: int = GROUPS, scratch: Scratch | None = None) -> DataFrame:
    """word, form, root (string), n, n_near, form_n (long) for words (word, n) of lower-case letters a-z and U+00C0 to U+00FF.

    Words are near that differ by exactly one inserted, deleted or replaced code point. A word's form
    is its near word of the largest n (ties: the least in code-point order) if that is at least
    ``ratio`` times its own n (``ratio`` at least 2), else null; root follows forms to the last.

    Defined cases: words are distinct and not null; a word without near words has n_near 0 and is
    its own root; words may be of any length; no words give an empty table.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, else forms may run in circles")
    scratch = scratch or Scratch(words.sparkSession, "spelling")
    near = near_words(words, scratch, groups)
    good = F.col("near_n") >= F.lit(ratio) * F.col("n")
    judged = words.join(near, "word", "left").select("word", F.when(good, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("near_n")).alias("form_n"))
    judged = scratch.keep(judged, "judged")
    roots = _roots(judged.where("form is not null").select("word", "form"), scratch)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_of_documents(docs: DataFrame, least_chars: int = 5, least_n: int = 3, drop_every: int = 0) -> DataFrame:
    """``spelling_variants`` of the words of whole texts (``count_words``).

    Defined cases: a null text has no words; runs of letters may be of any length; repeated rows
    count again; extra columns are not read; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    return spelling_variants(scratch.keep(count_words(docs, least_chars, least_n, drop_every), "words"), scratch=scratch)
