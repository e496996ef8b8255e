"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 2- and 3-grams for each language are summed in Spark over a documented sample of
the labelled texts; the matrix of log probabilities (buckets x languages) is broadcast, and each
Arrow batch is scored by gathering its n-grams' rows and adding them up for each text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._scratch import fresh

BUCKETS = 1 << 15
#: About so many texts of each language are learned from, those of the least hash of their id.
TEXTS_PER_LANGUAGE = 4000
MAX_LANGUAGES = 2000
_CHUNK = 1 << 16


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, hashed n-grams of a run of texts, and where each row's begin; long texts come in several pieces."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), _CHUNK):
            part = text[at : at + _CHUNK].lower()
            rows.append(row)
            parts.append(part)
            size += len(part)
            if size >= _CHUNK:
                yield _grams(rows, parts)
                rows, parts, size = [], [], 0
    if parts:
        yield _grams(rows, parts)


def _grams(rows: list[int], parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # Two spaces close each text, so that no n-gram spans two texts and the shortest text has some.
    points = np.frombuffer("".join(p + "  " for p in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(p) + 2 for p in parts])
    h2 = points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA77)
    h3 = h2[:-1] * np.uint32(0x27D4EB2F) + points[2:] * np.uint32(0xC2B2AE3D) + np.uint32(0x165667B1)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    both = np.zeros((points.size, 2), dtype=np.int64)
    both[:-1, 0] = (h2 ^ (h2 >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift
    both[:-2, 1] = (h3 ^ (h3 >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift
    ends = np.cumsum(lengths)
    keep = np.ones(points.size, dtype=bool)
    keep[ends - 1] = keep[ends - 2] = False
    return np.array(rows), both[keep].ravel(), 2 * (np.cumsum(lengths - 2) - (lengths - 2))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for rows, grams, starts in _pieces(batch.column("text").to_pylist()):
            for row, part in zip(rows, np.split(grams, starts[1:])):
                if langs[row] not in totals:
                    totals[langs[row]] = np.zeros(BUCKETS, np.int64)
                totals[langs[row]] += np.bincount(part, minlength=BUCKETS)
    for lang, n in totals.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * at.size, pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])


@dataclass(frozen=True)
class Model:
    langs: list[str]
    log_p: np.ndarray  # (languages, buckets)
    prior: np.ndarray

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        total = np.tile(self.prior, (len(texts), 1))
        for rows, grams, starts in _pieces(texts):
            for k in range(len(self.langs)):
                np.add.at(total[:, k], rows, np.add.reduceat(self.log_p[k][grams], starts))
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total)
        return p / p.sum(axis=1, keepdims=True)


def train(docs: DataFrame, usable: Column | None = None, texts_per_language: int = TEXTS_PER_LANGUAGE, smoothing: float = 0.5) -> Model:
    """Learn from ``text`` and ``lang`` of the rows where ``usable`` holds; null languages, texts and ids are not used."""
    ship(docs.sparkSession)
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    known = known if usable is None else known.where(usable)
    sizes = known.groupBy("lang").agg(F.count("*").alias("texts")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0))
    share = F.coalesce(*(F.when(F.col("lang") == r["lang"], F.lit(min(1.0, texts_per_language / r["texts"]))) for r in sizes)) if len(sizes) <= 200 else None
    if share is None:
        table = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, texts_per_language / r["texts"])) for r in sizes], "lang string, share double")
        known, share = known.join(F.broadcast(table), "lang"), F.col("share")
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    counts = drawn.select("lang", F.col("text").cast("string").alias("text")).mapInArrow(_count, "lang string, bucket long, n long")
    langs = [r["lang"] for r in sizes]
    n = np.full((len(langs), BUCKETS), smoothing)
    place = {lang: k for k, lang in enumerate(langs)}
    for r in counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        n[place[r["lang"]], r["bucket"]] += r["n"]
    texts = np.array([r["texts"] for r in sizes], float)
    return Model(langs, np.log(n / n.sum(axis=1, keepdims=True)), np.log(texts / texts.sum()))


def with_languages(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score (the posterior, 0 to 1) to every row.

    A null text, or one without letters, is ``und`` with score 0; so is every text if nothing was
    learned. Ties go to the language that sorts first. Repeated rows are judged each, texts of any
    length as a whole; other columns are carried along whatever their names, but for columns named
    lang_pred and score, which are replaced; an empty table gives an empty table.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def judge(texts: pa.Array) -> pa.Array:
        m = shared.value
        p = m.posteriors(texts.to_pylist())
        best = p.argmax(axis=1)
        return pa.StructArray.from_arrays([pa.array([m.langs[k] for k in best], pa.string()), pa.array(p.max(axis=1))], ["lang", "score"])

    text = F.col("text").cast("string")
    if not model.langs:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    judged, letters = fresh([*docs.columns, "lang_pred", "score"], "judged", "letters")
    out = docs.withColumn(judged, judge(text)).withColumn(letters, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    out = out.withColumn("lang_pred", F.when(F.col(letters), F.col(judged)["lang"]).otherwise("und"))
    return out.withColumn("score", F.when(F.col(letters), F.col(judged)["score"]).otherwise(0.0)).drop(judged, letters)
