"""Quality classifier: document scores learned from preference pairs (Bradley-Terry).

A document labelled 1 is preferred to one labelled 0. The chance that a is preferred to b is the
logistic function of s(a) - s(b), with s linear in the text's features, so the weights minimise
the logistic loss on feature differences. The threshold is the quantile of the training scores
that separates the two labels best, and scores are mapped to 0..1 so that it falls on ``CUT``.

Features describe form, not topic: shares of character kinds, lengths of words and lines, and how
much is repeated. They are computed from Arrow batches with numpy; scoring is one pass without a
shuffle. Fitting uses at most ``MAX_LABELLED`` labelled rows, those of the least hash of their id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._scratch import sized_join
from ._text import utf8, word_hashes

MAX_LABELLED = 20_000
PAIRS = 60_000
CUT = 0.3

#: Kinds of bytes: lower case, upper case, digit, space, line feed, sentence mark, exclamation mark, junk symbol, first byte of other letters, rest.
_KINDS = np.full(256, 9, dtype=np.int64)
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58] = 0, 1, 2
for _chars, _kind in ((b" \t", 3), (b"\n", 4), (b".,;:?", 5), (b"!", 6), (b"#*$%&|<>", 7)):
    _KINDS[list(_chars)] = _kind
_KINDS[0xC0:] = 8
_N = 10


def features(column: pa.Array) -> np.ndarray:
    """One row of features for each text; a null is an empty text."""
    data, offsets = utf8(column)
    size = np.diff(offsets)
    counts = np.zeros((len(size), _N))
    step = 1 << 20
    for at in range(0, data.size, step):
        piece = data[at : at + step]
        first = int(np.searchsorted(offsets, at, side="right")) - 1
        last = int(np.searchsorted(offsets, at + piece.size, side="left"))
        of = np.repeat(np.arange(first, last), np.diff(np.clip(offsets[first : last + 1] - at, 0, piece.size)))
        counts[first:last] += np.bincount((of - first) * _N + _KINDS[piece], minlength=(last - first) * _N).reshape(-1, _N)
    words = np.zeros(len(size))
    distinct = np.zeros(len(size))
    pairs = np.zeros(len(size))
    top = np.zeros(len(size))
    for i, _, h, starts in word_hashes(column):
        for k in range(len(starts) - 1):
            w = h[starts[k] : starts[k + 1]]
            if w.size:
                words[i + k] = w.size
                s = np.sort(w)
                new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                distinct[i + k] = new.size
                top[i + k] = np.diff(np.concatenate([new, [w.size]])).max()
                p = np.sort(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])
                pairs[i + k] = 1 + (p[1:] != p[:-1]).sum() if p.size else 1
    shares = counts / np.maximum(size, 1)[:, None]
    some = np.maximum(words, 1)
    lines = counts[:, 4] + 1
    return np.column_stack([shares, np.log1p(size), np.log1p(words), size / some / 10, distinct / some, pairs / some, top / some, np.log1p(words / lines), counts[:, 7] / some, counts[:, 6] / some])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def _terms(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.hstack([z, z * z])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self._terms(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, CUT at the threshold; 0 for texts without words."""
        out = 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.threshold) + np.log(CUT / (1 - CUT)), -40, 40)))
        out = np.where(self.raw(x) >= self.threshold, np.maximum(out, CUT), np.minimum(out, np.nextafter(CUT, 0)))
        return np.where(x[:, 11] > 0, out, 0.0)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Model:
    """Weights, threshold and scale from features and labels 0/1; with one label only, every text scores the same."""
    width = x.shape[1] if x.ndim == 2 else 19
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not good.size or not bad.size:
        at = 0.0 if good.size or not bad.size else 1.0
        return Model(np.zeros(width), np.ones(width), np.zeros(2 * width), at, 1.0)
    mean, deviation = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model = Model(mean, deviation, np.zeros(2 * width), 0.0, 1.0)
    terms = model._terms(x)
    rng = np.random.default_rng(seed)
    difference = terms[rng.choice(good, PAIRS)] - terms[rng.choice(bad, PAIRS)]
    w = np.zeros(2 * width)
    for _ in range(25):  # Newton steps on the pairs' logistic loss with a small ridge
        p = 1 / (1 + np.exp(np.clip(difference @ w, -40, 40)))
        slope = difference.T @ p / PAIRS - 1e-3 * w
        curve = (difference * (p * (1 - p))[:, None]).T @ difference / PAIRS + 1e-3 * np.eye(w.size)
        move = np.linalg.solve(curve, slope)
        w = w + move * min(1.0, 5 / max(np.linalg.norm(move), 1e-12))
        if np.linalg.norm(move) < 1e-6:
            break
    raw = terms @ w
    levels = np.unique(np.quantile(raw, np.linspace(0.002, 0.998, 499)))
    order = np.sort(raw[bad]), np.sort(raw[good])
    caught = np.searchsorted(order[0], levels) / bad.size
    kept = 1 - np.searchsorted(order[1], levels) / good.size
    best = np.flatnonzero((caught + kept) >= (caught + kept).max() - 1e-12)
    threshold = float(levels[best[best.size // 2]])
    spread = max(float(np.std(raw)), 1e-6)
    return Model(mean, deviation, w, threshold, 3 / spread)


def scorer(model: Model):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features(texts)))

    return score


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on ``docs`` (doc_id, text) with ``labels`` (doc_id, quality); ``usable`` limits the label rows.

    Null ids, and labels other than 0 and 1, are not used. A doc_id counts once, however often its
    rows or labels repeat: the least features, then the least label. So the driver gets at most
    ``max_labelled`` rows of features.
    """
    ship(docs.sparkSession)
    known = labels.where("doc_id is not null and quality in (0, 1)")
    known = known if usable is None else known.where(usable)
    sample = known.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    @F.arrow_udf("array<double>")
    def describe(texts: pa.Array) -> pa.Array:
        x = features(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    rows = sized_join(docs.select("doc_id", F.col("text").cast("string").alias("text")), sample, "doc_id", "inner", 16, max_labelled)
    once = rows.select("doc_id", "quality", describe("text").alias("x")).groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("r"))
    got = sorted(once.select("doc_id", "r.quality", "r.x").collect(), key=lambda r: r["doc_id"])
    return fit(np.array([r["x"] for r in got]), np.array([r["quality"] for r in got]))


def held_out(parts: int = 5, part: int = 0) -> Column:
    """Whether the row belongs to the part of ids that is kept from fitting."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))


def with_scores(docs: DataFrame, model: Model, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 where score is at least CUT) to every row.

    Null texts score as empty ones: 0. Equal texts score alike, whatever their other columns,
    which are carried along; columns of the two names are replaced. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    return docs.withColumn(score, scorer(model)(F.col("text").cast("string"))).withColumn(predicted, (F.col(score) >= CUT).cast("int"))
