from scarpline.llm import common, decontam

ITEM = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_rows_of_one_doc_id_are_judged_apart(spark):
    half, other = "w1 w2 w3 w4 w5 w6 x x x x x x x", "z z z z w5 w6 w7 w8 w9 w10 x x x"
    rows = [(1, half), (1, other), (2, f"a {ITEM} b"), (2, "clean words"), (None, f"{ITEM} c"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["contaminated"]) for r in decontam.contamination(docs, bench(spark, [(1, ITEM)])).collect())
    assert got == [(0, 1, 0, False), (0, 11, 10, True), (1, 13, 0, False), (1, 13, 0, False), (2, 2, 0, False), (2, 12, 10, True)]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in decontam.clean(docs, bench(spark, [(1, ITEM)])).collect())
    assert kept == [(0, "c"), (1, half), (1, other), (2, "clean words")]


def test_a_window_of_very_many_items_and_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{ITEM} {ITEM}") for i in range(50)], "doc_id long, text string")
    items = bench(spark, [(k, ITEM) for k in range(300)] + [(k, ITEM) for k in range(5)])
    for size in (common.BROADCAST_BYTES, -1):
        monkeypatch.setattr(common, "BROADCAST_BYTES", size)
        got = decontam.contamination(docs, items).collect()
        assert len(got) == 50 and all((r["n_hit"], r["n_items"], r["items"]) == (20, 300, sorted(map(str, range(300)))) for r in got)


def test_clean_keeps_columns_nulls_and_repeats(spark):
    rows = [(1, None, 5, "r"), (1, None, 5, "r"), (2, "", 6, "r"), (3, f"So {ITEM.upper()}.", 7, "r"), (4, "fine " * 100_000, 8, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, row string")
    assert sorted(r["doc_id"] for r in decontam.clean(docs, bench(spark, [(1, ITEM), (2, None)])).collect()) == [1, 1, 2, 4]
    assert decontam.clean(docs, bench(spark, [])).columns == docs.columns
    assert decontam.clean(docs.filter("false"), bench(spark, [(1, ITEM)])).count() == 0
