"""Each stage of the pipeline on no rows, and on null, empty, very long, repeated and unnamed ones with more columns than it knows."""

import pytest

import corpus_pipeline

BASE = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} of the long text number {i}" for i in range(12_000))
ROWS = [(1, LONG, "en", "web", 1), (2, LONG + " and its end", "en", "web", 1), (3, None, None, None, None), (4, "", "en", None, 0), (4, "another text under the same number", "en", "web", 35), (None, "a text without a number of its own", None, "web", 34), (6, "the same row twice in this table", "en", "web", 32), (6, "the same row twice in this table", "en", "web", 32), (7, "12345 67890", "en", "web", 11)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage(spark, name, stage):
    extra = spark.createDataFrame(ROWS, KINDS).selectExpr("*", "1 AS row", "'x' AS node", "2 AS n", "3 AS fp", "4 AS line_no", "5 AS length")
    got = stage(spark, extra, BASE).collect()
    none = stage(spark, extra.limit(0), BASE)
    assert none.count() == 0
    texts = [(r["doc_id"], r["text"]) for r in got] if "text" in got[0] else None
    if name != "packing":
        assert tuple(none.columns) == corpus_pipeline.COLUMNS
    if name == "line_dedup":
        assert len(got) == len(ROWS) and (3, None) in texts and (4, "") in texts and (4, ROWS[4][1]) in texts
    if name == "near_duplicates":
        assert sorted(map(str, texts)) == sorted(map(str, [(1, LONG), (3, None), (4, ROWS[4][1]), (None, ROWS[5][1]), (6, ROWS[6][1]), (7, ROWS[8][1])]))
    if name == "decontamination":
        assert len(got) == len(ROWS)
    if name == "packing":
        pieces = {(r["doc_id"], r["piece"]) for r in got}
        assert {(3, 0), (4, 0), (None, 0), (6, 0)} <= pieces and len([p for p in got if p["doc_id"] == 1]) > 50
        assert all(r["length"] <= 1024 and r["offset"] + r["length"] <= 1024 for r in got)
        taken = {}
        for r in got:
            taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert all(sum(n for _, n in own[:k]) == at for own in map(sorted, taken.values()) for k, (at, _) in enumerate(own))
