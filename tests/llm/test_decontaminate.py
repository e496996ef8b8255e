from strandline.llm.decontaminate import contained_items, without_contaminated

ITEM = "one two three four five six seven eight nine ten eleven twelve"


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, item_id long")
    return d, spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, shingles string")


DOCS = [
    (1, "before it " + ITEM.upper().replace(" ", ", ") + " and after it"),
    (2, "nothing of it here but other words of some length and more of them"),
    (3, None),
    (4, ""),
    (5, " ".join(ITEM.split()[:8])),
    (6, "yes it is"),
    (7, "well yes it is so"),
    (None, ITEM),
    (1, "before it " + ITEM.upper().replace(" ", ", ") + " and after it"),
    (8, "word " * 30000 + ITEM.replace("twelve", "thirteen") + " tail" * 20000),
]
ITEMS = [(10, ITEM), (10, ITEM), (11, None), (12, ""), (13, "Yes, it is!"), (None, ITEM)]


def test_edges(spark):
    got = contained_items(*tables(spark, DOCS, ITEMS)).collect()
    pairs = sorted(((r.doc_id or 0), (r.item_id or 0), r.n_item, r.n_common) for r in got)
    assert pairs == sorted([(1, 10, 8, 8)] * 2 + [(1, 0, 8, 8)] * 2 + [(0, 10, 8, 8), (0, 0, 8, 8), (6, 13, 1, 1), (8, 10, 8, 7), (8, 0, 8, 7)])


def test_removal_and_empty_tables(spark):
    docs, items = tables(spark, DOCS, ITEMS)
    kept = without_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 7]
    none_docs, none_items = tables(spark, [], [])
    assert contained_items(none_docs, items).count() == 0
    assert without_contaminated(docs, none_items).count() == docs.count()


def test_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "clean words only", 5, 6)], "doc_id long, text string, key int, __key int")
    items = spark.createDataFrame([(1, "something else that is not here at all")], "item_id long, text string")
    kept = without_contaminated(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "clean words only", 5, 6)]
