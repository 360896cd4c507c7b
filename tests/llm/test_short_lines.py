import corpus_pipeline


def test_equal_short_lines_go_in_the_pipeline(spark):
    rows = [(1, "a\nshort\nb c"), (2, "short\n\n\nnew"), (3, " b c \nbc\nshart"), (4, "short\n\n a")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert got == {1: ("a\nshort\nb c", 11), 2: ("\n\nnew", 5), 3: ("bc\nshart", 8)}
