from scarpline.llm import simhash


def test_each_group_keeps_a_row_whatever_its_ids(spark):
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(30)) for w in "abcd")
    rows = [(None, one, 1), (None, one, 2), (None, two, 1), (5, two, 1), (6, two, 1), (7, three, 1), (7, four, 1), (None, "", 1), (None, None, 1)]
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    texts = sorted((r["text"] or "", r["doc_id"]) for r in got)
    assert texts == sorted([(one, None), (two, 5), (three, 7), (four, 7), ("", None)], key=lambda r: r[0])
