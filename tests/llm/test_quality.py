import re
from collections import Counter

import numpy as np
from strandline.llm import quality_classifier as qc
from strandline.llm.quality_rules import learn_rules, with_statistics, with_verdict

GOOD = "this is a plain sentence about the {} weather that goes on for a while and says a number of things about nothing in particular to reach some length"
BAD = "buy$$$ now### the {} best%%% deal&&& of*** all$$$ times### is%%% here&&& for*** you$$$ only### today%%% so&&& come*** on$$$ in### and%%% get&&& it*** all$$$"


def tables(spark):
    data = [(i, (GOOD if i % 3 else BAD).format(f"w{i}"), "x") for i in range(240)] + [(1000, None, "x"), (1001, "", "x"), (1002, "two words", "x"), (None, GOOD.format("n"), "x"), (1003, "again and again we say the same eight words " * 9, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, rule string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(None, 1, 0), (5, None, 0), (9999, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_statistics_of_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b\n\na b\n \nc # é|"), (4, "one two three four five six seven eight " * 2)], "doc_id long, text string")
    got = {r.doc_id: r for r in with_statistics(docs).collect()}
    assert [(got[k].n_words, got[k].word_chars, got[k].n_symbols, got[k].n_dup_lines, got[k].n_repeat_words) for k in (1, 2, 3, 4)] == [(0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (7, 8, 2, 1, 0), (16, 64, 0, 0, 16)]
    assert [got[k].base_failed for k in (1, 2, 3, 4)] == [True] * 4


def test_rules_separate(spark):
    docs, labels = tables(spark)
    stats = with_statistics(docs)
    rules = learn_rules(stats, labels)
    assert rules
    got = {r.doc_id: r.kept for r in with_verdict(stats, rules).collect()}
    assert all(got[i] == (i % 3 > 0) for i in range(240))
    assert not any(got[i] for i in (1000, 1001, 1002, 1003))


def test_rules_without_examples(spark):
    docs, labels = tables(spark)
    stats = with_statistics(docs)
    assert learn_rules(stats, labels.where("quality = 1")) == []
    assert learn_rules(stats.where("false"), labels) == []
    assert with_verdict(stats.where("false"), []).count() == 0


def test_classifier_separates_held_out_rows(spark):
    docs, labels = tables(spark)
    held = qc.held_out(5, 0)
    model = qc.train(docs, labels, ~held)
    got = {r.doc_id: r for r in qc.with_scores(docs, model).collect()}
    assert all(got[i].predicted == int(i % 3 > 0) for i in range(240))
    assert got[1000].score == got[1001].score == 0.0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_classifier_with_one_label_and_empty_table(spark):
    docs, labels = tables(spark)
    model = qc.train(docs, labels.where("quality = 1"))
    assert {r.predicted for r in qc.with_scores(docs.where("doc_id < 10"), model).collect()} == {1}
    assert qc.with_scores(docs.where("false"), model).count() == 0


def test_pairs_decide_the_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 19))
    x[:, 11] = 1
    y = (x[:, 0] + 0.1 * rng.normal(size=400) > 0).astype(int)
    model = qc.fit(x, y)
    assert ((model.score(x) >= qc.CUT).astype(int) == y).mean() > 0.9


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(repeated)


def test_statistics_of_all_documents_equal_plain(spark, sf):
    from strandline.llm.queries import op2_quality_rules

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
    assert any(r.n_repeat_words for r in rows) and any(r.n_dup_lines for r in rows)


def test_statistics_of_odd_rows(spark):
    """Very long texts, repeated rows, and columns named as the statistics."""
    long = "one two three four five six seven eight nine\n" * 4000 + "#" * 300_000
    rows = [(1, long, 5, "x"), (1, long, 5, "x"), (2, None, None, None), (3, "", 1, "y"), (4, "a|b " * 9, 1, "z")]
    got = with_statistics(spark.createDataFrame(rows, "doc_id long, text string, windows long, words string"))
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect()))
    assert got == sorted((d, *plain_statistics(t)) for d, t, *_ in rows)


def test_repeated_ids_count_once(spark, monkeypatch):
    """A doc_id in thousands of rows is one row of the fit."""
    docs, labels = tables(spark)
    seen, fit = [], qc.fit
    monkeypatch.setattr(qc, "fit", lambda x, y: seen.append(len(x)) or fit(x, y))
    one = qc.train(docs, labels)
    many = qc.train(docs.union(docs.where("doc_id = 3").crossJoin(spark.range(3000)).drop("id")), labels.union(labels.where("doc_id < 20")))
    assert seen[0] == seen[1] and (one.weights == many.weights).all() and one.threshold == many.threshold
