import random

import brute
import numpy as np
import pyarrow as pa
from strandline.llm import blocks, lists, ngram_join
from strandline.llm._text import shingle_sets, word_hashes

EDGES = [
    (1, "the quick brown fox jumps over the lazy dog today"),
    (2, "The QUICK brown\tfox jumps over\nthe lazy dog today"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "two words"),
    (7, "Two  words"),
    (8, "words two"),
    (9, "é É über\x85straße\x1cx"),
    (10, "é É über\x85straße\x1cx"),
    (None, "the quick brown fox jumps over the lazy dog today"),
    (None, "nobody else says this at all in any place"),
    (2, "The QUICK brown\tfox jumps over\nthe lazy dog today"),
]


def near_copies(seed, n, length, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def rows(spark, data):
    return spark.createDataFrame([(i, t, "b", 7) for i, t in data], "doc_id long, text string, block string, component long")


def test_edges(spark):
    found = ngram_join.ngram_jaccard_components(rows(spark, EDGES), 4, 85).collect()
    assert len(found) == len(EDGES)
    got = sorted((((r.doc_id if r.doc_id is not None else 99), r.n_shingles, r.component_id) for r in found), key=str)
    assert sorted(got, key=str) == sorted([(1, 7, 1), (2, 7, 1), (2, 7, 1), (99, 7, 1), (99, 6, None), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, 1, 8), (9, 1, 9), (10, 1, 9)], key=str)


def test_empty_table(spark):
    assert ngram_join.ngram_jaccard_components(rows(spark, []), 4, 85).count() == 0


def test_against_brute_force_with_split_blocks(spark):
    texts = near_copies(1, 60, 80, 6) + near_copies(2, 25, 30, 3) + near_copies(3, 6, 2000, 90)
    data = [(k * 3, t) for k, t in enumerate(texts)]
    for width, percent, most in ((5, 80, 1000), (4, 85, 10)):
        found = ngram_join.ngram_jaccard_components(rows(spark, data), width, percent, max_items=most).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.components(data, width, percent)


def test_one_of_each_group_stays(spark):
    kept = ngram_join.keep_one_of_each(rows(spark, EDGES), 4, 85)
    assert kept.columns == ["doc_id", "text", "block", "component"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 8, 9]
    again = ngram_join.keep_one_of_each(rows(spark, [*EDGES, (8, "words two"), (8, "another text of this document")]), 4, 85)
    assert sorted(r.text for r in again.collect() if r.doc_id == 8) == ["another text of this document", "words two"]


def linked_pairs(exact, percent):
    for i in range(len(exact)):
        for j in range(i):
            common = len(exact[i] & exact[j])
            if exact[i] != exact[j] and 100 * common >= percent * (len(exact[i]) + len(exact[j]) - common):
                yield i, j


def test_short_lists_and_bitmaps_lose_no_link():
    rng = random.Random(5)
    for percent in (60, 80, 85, 95):
        for length in (4, 9, 25, 150):
            texts = sorted(set(near_copies(rng.random(), 12, length, 3)))
            sets = [s for _, s in shingle_sets(pa.array(texts), 4)]
            exact = [brute.shingles(t, 4) for t in texts]
            table = np.random.default_rng(length).integers(0, 9, ngram_join.SLOTS)
            posted = [set(ngram_join.rarest(s, percent, table)[0].tolist()) for s in sets]
            maps = lists.bitmaps(np.concatenate(sets), np.array([s.size for s in sets])).to_pylist()
            up = list(range(len(sets)))
            for members in lists.clusters([s.size for s in sets], maps, percent):
                for i in members:
                    up[i] = members[0]
            for i, j in linked_pairs(exact, percent):
                assert posted[i] & posted[j]
                assert up[i] == up[j]
                assert lists.clusters([sets[i].size, sets[j].size], [maps[i], maps[j]], percent) == [[0, 1]]
            assert blocks.link(sets, percent)[0].tolist() == brute.classes(exact, percent)


def test_links_come_from_merged_and_probed_lists():
    texts = near_copies(8, 30, 120, 6)
    sets = [s for _, s in shingle_sets(pa.array(texts), 4)]
    exact = [brute.shingles(t, 4) for t in texts]
    partners = {i: {j for j in range(len(sets)) if j != i and 100 * len(exact[i] & exact[j]) >= 85 * len(exact[i] | exact[j])} for i in range(len(sets))}
    assert sum(map(len, partners.values())) > 40
    index = blocks.Index(sets)
    for i in partners:
        merged, probed = index.merged, index.probed
        assert set(index.partners(i, 85, np.ones(len(sets), dtype=bool)).tolist()) == partners[i]
        if partners[i]:
            assert index.merged > merged and index.probed > probed
    two = blocks.Index(sets[:2])
    assert two.partners(0, 1, np.ones(2, dtype=bool)).tolist() == [1] and two.merged


def gathered(postings):
    """Groups and sure edges of postings (list, spread, id), in batches of 7."""
    rows = sorted(postings, key=lambda p: (p[1], p[0], p[2]))
    names = ["list", "spread", "id"]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + 7]], pa.int64()) for k in range(3)], names) for at in range(0, len(rows), 7)]
    groups, sure = {}, set()
    for batch in lists._gather(batches):
        for group, item, edge in zip(*(c.to_pylist() for c in batch.columns)):
            if edge:
                sure.add((item, group))
            else:
                groups.setdefault(group, set()).add(item)
    return sorted(map(sorted, groups.values())), sure


def test_lists_become_groups_and_long_ones_edges(monkeypatch):
    monkeypatch.setattr(lists, "LONGEST", 10)
    data = [(1, 0, 5), (1, 0, 6), (2, 0, 5), (2, 0, 6), (3, 0, 9), (4, 0, 7), (4, 0, 7)]
    data += [(5, 0, k) for k in range(100, 260)] + [(6, 0, k) for k in range(300, 310)] + [(8, 0, k) for k in range(400, 411)] + [(7, 3, 1), (7, 9, 2)]
    groups, sure = gathered(data)
    assert groups == [[5, 6], list(range(300, 310))]
    assert sure == {(k, 5) for k in range(100, 260)} | {(k, 8) for k in range(400, 411)} | {(1, 7), (2, 7)}
    assert gathered([]) == ([], set())


def test_hot_lists_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(lists, "LONGEST", 10)
    monkeypatch.setattr(ngram_join, "LONGEST", 10)
    monkeypatch.setattr(blocks, "FEW", 3)
    texts = near_copies(4, 70, 60, 3)
    data = [(k, t) for k, t in enumerate(texts)]
    found = ngram_join.ngram_jaccard_components(rows(spark, data), 4, 85, max_items=20).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.components(data, 4, 85)


def test_words_of_long_and_odd_texts():
    text = "aé b\x0bc\x85d " * 400_000
    column = pa.array([None, "", text, "x"])
    got = {i + k: int(starts[k + 1] - starts[k]) for i, j, _, starts in word_hashes(column) for k in range(j - i)}
    assert got == {0: 0, 1: 0, 2: len(text.encode().split()), 3: 1}
