from strandline.llm import language_id
from strandline.llm.quality_classifier import held_out


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = held_out(3, 1)
    found = language_id.with_languages(docs, language_id.train(docs, ~held)).where(held).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)


def test_edges(spark):
    data = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "12 34!", "de"), (5, "", None), (6, "und der hund", None), (None, "the dog", "en"), (7, "the " * 60000, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in data], "doc_id long, text string, lang string, score double")
    model = language_id.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.with_languages(docs, model).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "de", None: "en", 7: "en"}
    assert all(0 <= v[1] <= 1 for v in got.values())
    nothing = language_id.train(docs.where("false"))
    assert {r.lang_pred for r in language_id.with_languages(docs, nothing).collect()} == {"und"}
    assert language_id.with_languages(docs.where("false"), model).count() == 0


def test_clashing_names_stay(spark):
    docs = spark.createDataFrame([(k, "the word and the other" if k % 2 else "das wort und das andere", "en" if k % 2 else "de", 3, 4) for k in range(20)], "doc_id long, text string, lang string, judged int, __letters int")
    out = language_id.with_languages(docs, language_id.train(docs))
    assert out.columns == [*docs.columns, "lang_pred", "score"]
    assert all(r.lang == r.lang_pred and (r.judged, r["__letters"]) == (3, 4) for r in out.collect())
