import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import LOWER
from strandline.llm import _scratch, spelling
from strandline.llm.spelling import count_words, spelling_variants, variants_of_documents

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_counts(rows, least_chars, least_n, every):
    found = Counter()
    for d, text in rows:
        for w in RUN.findall(text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{d}:{w}".encode())
            if every and d is not None and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= least_chars and n >= least_n}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def plain_variants(counts):
    form, out = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        out[w] = len(near)
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, out[w], counts[form[w]] if form[w] else None))
    return rows


def random_rows(seed, n=250):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abeinostéÿÀ×") for _ in range(rng.randint(4, 9))) for _ in range(25)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(rng.randint(0, 25)):
            w = list(base[min(int(rng.expovariate(0.25)), 24)])
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = rng.choice(["", "a", "é", "Z"])
            words.append("".join(w))
        rows.append((rng.choice([k, None if k % 17 == 0 else -k]), rng.choice([" ", "1", "ā", "-"]).join(words)))
    return [*rows, (3, None), (4, ""), rows[0]]


@pytest.mark.parametrize(("seed", "bound"), [(0, 32 << 20), (1, 0)])
def test_against_plain(spark, seed, bound, monkeypatch):
    monkeypatch.setattr(_scratch, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(spelling, "_BLOCK", 8)
    rows = random_rows(seed)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = {tuple(r) for r in variants_of_documents(docs, 5, 3, 7).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = plain_variants(plain_counts(rows, 5, 3, 7))
    assert got == want and sum(r[1] is not None for r in want) > 50


def test_query(spark, sf):
    from strandline.llm.queries import op13_spelling_variants

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts = plain_counts(rows, 5, 3, 97)
    got = op13_spelling_variants(spark, sf).collect()
    assert {r.word: r.n for r in got} == counts
    if len(counts) < 5000:
        assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == plain_variants(counts)


def test_chains_ties_and_long_words(spark):
    long = "ab" * 3000
    counts = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "qqqqq": 3, "qqqqr": 6, "qqqqs": 6, "lonely": 9, "lonley": 9, long: 5, long + "c": 11, "é" + long: 10}
    got = {r.word: r for r in spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert {tuple(got[w][c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for w in got} == plain_variants(counts)
    assert got["aaaaa"].root == "abbbb" and got["qqqqq"].form == "qqqqr" and got["lonely"].n_near == 0 and got[long].form == long + "c"


def test_one_long_run_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_PIECE", 64)
    rows = [(1, "x" * 500 + " " + "word up " * 200 + "y" * 70 + "é"), (2, "é" * 300 + " " + "words " * 300), (2, "x" * 500)]
    got = {r.word: r.n for r in count_words(spark.createDataFrame(rows, "doc_id long, text string"), 4, 1, 3).collect()}
    assert got == plain_counts(rows, 4, 1, 3)


def test_crc32():
    rng = random.Random(5)
    words = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 5, 64, 65, 200]))) for _ in range(200)]
    ends = np.cumsum([len(w) for w in words])
    seeds = [zlib.crc32(b"%d:" % k) for k in range(200)]
    got = spelling._crc32(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends, np.array(seeds, np.uint32))
    assert got.tolist() == [zlib.crc32(w, s) for w, s in zip(words, seeds)]


def test_no_words(spark):
    assert variants_of_documents(spark.createDataFrame([(1, "a b 12"), (2, None)], "doc_id long, text string")).count() == 0
    assert variants_of_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(spark.createDataFrame([], "word string, n long"), ratio=1)
