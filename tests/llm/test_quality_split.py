"""Quality on documents whose labels neither fit nor calibrate the model, and views that share nothing."""

import os
import zlib

import pytest

from scarpline.llm import quality

DATA = "/root/testdata/sf0.1"


def fold(doc_id):
    return zlib.crc32(f"test {doc_id}".encode()) % 4


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
def test_a_clean_test_set(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    known = spark.createDataFrame([(k, int(r.quality), int(r.toxic)) for k, r in truth.items() if fold(k)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_documents(docs, known).collect() if r.doc_id in truth and not fold(r.doc_id)}
    assert len(got) > 100 and not any(r.labelled for r in got.values())
    right = {t: [(got[k][t] >= 0.5) == (truth[k][t] == 1) for k in got] for t in ("quality", "toxic")}
    shares = {t: sum(v) / len(v) for t, v in right.items()}
    base = {t: max(sum(truth[k][t] == y for k in got) for y in (0, 1)) / len(got) for t in right}
    print(len(got), shares, base)
    assert shares["quality"] > 0.93 and shares["toxic"] > 0.97 and all(shares[t] >= base[t] for t in shares)


def test_views_are_separate():
    slots = quality._Slots()
    assert quality.page_features(100, "en", "web", slots) == quality.page_features(101, "en", "web", slots)
    assert quality.page_features(None, None, None, slots) != quality.page_features(0, None, None, slots)
    assert not set(quality.text_features("web en size", slots)) & set(quality.page_features(3, "en", "web", slots))
