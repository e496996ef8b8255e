"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D in UTF-8 text whose A-Z are
lower-cased. A word's hash is a polynomial over its bytes, read off one prefix sum for a whole
batch, so the cost per character is a few numpy operations and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_ODD_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PIECE = 1 << 18
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_AS_IS = np.arange(256, dtype=np.uint8)
_LOWER = _AS_IS.copy()
_LOWER[65:91] += 32
_tables = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def lowered(b: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return _LOWER[b]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), so that every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def constants(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers of a seed."""
    return mix(np.arange(1, n + 1, dtype=_U) * _ODD + _U(seed)) | _U(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd base modulo 2**64, and of its inverse."""
    if _tables[0].size < n:
        size = max(n, 2 * _PIECE)
        for k, base in enumerate((_ODD, _ODD_INVERSE)):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _tables[k] = np.cumprod(steps)
    return _tables[0][:n], _tables[1][:n]


def released(run: Callable) -> Callable:
    """A mapInArrow function that hands free memory of Arrow's pool back when its task is over, as workers live on."""

    @wraps(run)
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return task


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def bounds(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the runs of true values; cuts are offsets at which a run ends whatever follows."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < inside.size)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_bounds(b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in b; cuts are offsets at which a word ends whatever follows."""
    return bounds(_WORD[b], cuts)


def run_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the runs of b from s to e."""
    up, down = powers(b.size)
    total = np.zeros(b.size + 1, dtype=_U)
    np.cumsum((b.astype(_U) + _U(1)) * up, out=total[1:])
    h = (total[e] - total[s]) * down[s]
    h += (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)
    return mix(h)


def _words(b: np.ndarray, cuts: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words in b, whose bytes are read through the table ``fold``."""
    s, e = word_bounds(b, cuts)
    return s, run_hashes(fold[b], s, e)


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of about _PIECE bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _PIECE, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def _long(b: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Word hashes of one very long text, worked off in pieces that end at white space."""
    out, at = [], 0
    while at < b.size:
        end = min(at + 4 * _PIECE, b.size)
        while end < b.size and _WORD[b[end]]:
            gap = np.flatnonzero(~_WORD[b[end : end + _PIECE]])
            end = end + int(gap[0]) if gap.size else min(end + _PIECE, b.size)
        out.append(_words(b[at:end], np.zeros(0, np.int64), fold)[1])
        at = end
    return np.concatenate(out)


def word_hashes(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: first and last row, the words' hashes (with A-Z as they are if not ``lower``), and where each text's words begin."""
    fold = _LOWER if lower else _AS_IS
    data, offsets = utf8(column)
    for i, j in pieces(offsets):
        size = int(offsets[j] - offsets[i])
        b = data[offsets[i] : offsets[j]]
        if j == i + 1 and size > 4 * _PIECE:
            h = _long(b, fold)
            yield i, j, h, np.array([0, h.size])
        elif size == 0:
            yield i, j, np.zeros(0, _U), np.zeros(j - i + 1, np.int64)
        else:
            cuts = offsets[i : j + 1] - offsets[i]
            s, h = _words(b, cuts, fold)
            yield i, j, h, np.searchsorted(s, cuts)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of each text.

    A text with fewer words than ``width`` has its whole sequence as its only shingle; one without
    words has none.
    """
    by = constants(width, width + 1)
    for i, _, h, starts in word_hashes(column):
        n = h.size - width + 1
        if n > 0:
            g = h[:n] * by[0]
            for k in range(1, width):
                g += h[k : n + k] * by[k]
            g = mix(g)
        for row in range(len(starts) - 1):
            a, z = int(starts[row]), int(starts[row + 1])
            if z - a >= width:
                s = np.sort(g[a : z - width + 1])
                keep = np.empty(s.size, dtype=bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield i + row, s[keep]
            elif z > a:
                yield i + row, mix((h[a:z] * by[: z - a]).sum(keepdims=True) + by[width:] * _U(z - a))
            else:
                yield i + row, np.zeros(0, _U)
