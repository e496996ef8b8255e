import random

import pytest
from brute import WORD
from pyspark.sql import functions as F
from strandline.llm import _scratch, substring_dedup
from strandline.llm.substring_dedup import without_repeated_windows

SCHEMA = "doc_id long, text string"


def plain(rows, width):
    """Kept words and number of removed words of each row, in the order of the rows."""
    words = [WORD.findall(t or "") for _, t in rows]
    order = [-(1 << 63) if d is None else d for d, _ in rows]
    first = {}
    for d, w in zip(order, words):
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, w in zip(order, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if (d, i) > first[tuple(w[i : i + width])]:
                gone |= set(range(i, i + width))
        out.append((" ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return out


def run(spark, rows, width, schema=SCHEMA):
    out = without_repeated_windows(spark.createDataFrame(rows, schema).repartition(3), width)
    return sorted((r.doc_id is not None, r.doc_id or 0, " ".join(WORD.findall(r.text or "")), r.n_words, r.n_removed) for r in out.collect())


def expect(rows, width):
    return sorted((d is not None, d or 0, *p) for (d, _), p in zip(rows, plain(rows, width)))


@pytest.mark.parametrize("seed", range(3))
def test_against_plain(spark, seed, monkeypatch):
    """Passages shared inside and between texts, ids in any order, repeated, null and far apart."""
    monkeypatch.setattr(substring_dedup, "_HELD", 50)
    rng = random.Random(seed)
    passage = [[rng.choice("abc") for _ in range(rng.randint(3, 9))] for _ in range(6)]
    rows = []
    for k in range(60):
        text = "".join(" ".join([*rng.choice(passage), rng.choice(["x", "y", "é", "A"])]) + rng.choice([" ", "\n", "\t "]) for _ in range(rng.randint(0, 5)))
        rows.append((rng.choice([k, k * 1000003, -k, 7, None]), rng.choice([text, text, text, None if k % 9 == 0 else text])))
    rows.append(rows[3])
    assert run(spark, rows, 4) == expect(rows, 4)


def test_text_outside_the_cuts_is_untouched(spark):
    rows = [(1, "a b c d"), (2, " x\n\na  b\tc d\n y z\n"), (3, "a b c d \n"), (4, "q a b c")]
    out = {r.doc_id: r for r in without_repeated_windows(spark.createDataFrame(rows, SCHEMA), 4).collect()}
    assert out[2].text == " x\n\ny z\n" and [(r["from"], r["to"]) for r in out[2].removed] == [(1, 5)]
    assert out[3].text == "" and out[4].text == "q a b c" and out[4].removed is None
    assert out[1].n_removed == 0 and out[3].n_words == 4


def test_touching_and_overlapping_windows_merge(spark):
    rows = [(1, "a b c"), (2, "d e f"), (3, "b c d"), (4, "a b c d e f g a b c")]
    out = {r.doc_id: r for r in without_repeated_windows(spark.createDataFrame(rows, SCHEMA), 3).collect()}
    assert [(r["from"], r["to"]) for r in out[4].removed] == [(0, 6), (7, 10)] and out[4].text == "g "


@pytest.mark.parametrize("bound", [0, 32 << 20])
def test_clashing_names_long_texts_and_no_broadcast(spark, bound, monkeypatch):
    monkeypatch.setattr(_scratch, "BROADCAST_BYTES", bound)
    long = " ".join(f"w{k}" for k in range(70_000))
    rows = [(1, long, 1, "p"), (2, "v " + long[:300_000].rsplit(" ", 1)[0], 2, "q"), (2, "other text", 3, None), (3, None, 4, ""), (4, "", 5, "s"), (5, "w69998 w69999 " + long, 6, "t")]
    schema = "doc_id int, text string, id int, copy string"
    out = without_repeated_windows(spark.createDataFrame(rows, schema), 20)
    assert out.columns == ["doc_id", "text", "id", "copy", "n_words", "n_removed", "removed"]
    got = {r.id: r for r in out.collect()}
    assert got[2].text == "v " and got[3].text == "other text" and got[4].text is None and got[5].text == ""
    assert got[6].n_removed == 70_000 and got[6].copy == "t" and got[1].n_removed == 0


def test_no_hash_is_hot(spark):
    """A task sends one window of a hash, the others by their position."""
    docs = spark.createDataFrame([(k, "same passage of words " * 8) for k in range(500)], SCHEMA).coalesce(1)
    packed = docs.select(F.col("doc_id"), F.lit(0).cast("long").alias("copy"), "text").mapInArrow(substring_dedup._packed(4, 8), substring_dedup._PACKED)
    by = packed.groupBy("bucket").agg(F.sum(F.size(F.filter("hashes", lambda h: h.isNotNull()))).alias("n"), F.sum(F.size("at")).alias("all")).collect()
    assert sum(r.n for r in by) == 4 and sum(r.all for r in by) == 500 * 29
    assert max(r.all for r in by) < 1.3 * 500 * 29 / 8


def test_empty_table(spark):
    out = without_repeated_windows(spark.createDataFrame([], "doc_id long, text string, more int"))
    assert out.columns == ["doc_id", "text", "more", "n_words", "n_removed", "removed"] and out.count() == 0
