import random

import zstandard

from scarpline.llm import langid


def prose(letters, n, seed):
    """n words from a vocabulary of 80 invented ones."""
    own, rnd = random.Random(letters), random.Random(seed)
    words = ["".join(own.choice(letters) for _ in range(own.randint(3, 9))) for _ in range(80)]
    return " ".join(rnd.choice(words) for _ in range(n))


def test_sizes_are_those_of_the_whole_text_under_each_dictionary():
    own = {"xa": prose("abcdef", 900, 1).encode(), "xb": prose("ghijkl", 900, 2).encode(), "xc": prose("abcghi", 900, 3).encode()}
    rnd = random.Random(4)
    classifier = langid.Classifier(own)
    for k in range(60):
        text = prose(rnd.choice(["abcdef", "ghijkl", "abcghi", "xyz"]), rnd.choice([1, 2, 30, 700, 2000]), k) * rnd.choice([1, 1, 3])
        sizes = []
        for data in own.values():
            one = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=langid.settings())
            sizes.append(sum(len(one.compress(text[at : at + langid.CHUNK_CHARS].encode())) for at in range(0, len(text), langid.CHUNK_CHARS)))
        found, score, margin = classifier.judge(text)
        assert found == list(own)[sizes.index(min(sizes))] and 1 / 3 <= score <= 1
        assert margin == (sorted(sizes)[1] - min(sizes)) / sorted(sizes)[1]


def test_repeats_count():
    """A text is compressed as it is: what is said once in one language and often in another is of the other."""
    a, b = prose("abcdef", 400, 1), prose("ghijkl", 400, 2)
    classifier = langid.Classifier({"xa": a.encode(), "xb": b.encode()})
    once = " ".join(a.split()[:40])
    assert classifier.judge(once)[0] == "xa"
    assert classifier.judge(" ".join([*a.split()[:40], *b.split()]))[0] == "xb"


def test_held_out_accuracy_of_each_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = langid.op9_rows(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    got = {r["lang"]: r for r in found.groupBy("lang").agg({"*": "count"}).join(found.filter("lang = lang_pred").groupBy("lang").count(), "lang").collect()}
    assert set(got) == {"de", "en", "es", "fr"}
    for r in got.values():
        assert r["count"] / r["count(1)"] > 0.98
    assert found.filter("rejected").count() / found.count() < 0.02


def test_narrow_margins_are_rejected_and_letters_are_those_of_unicode(spark):
    own = {"xa": prose("abcdef", 900, 1).encode(), "xb": prose("ghijkl", 900, 2).encode()}
    texts = [prose("abcdef", 50, 3), "qq ww", "² ½ 12 !", "Ⅷ", None, "", "é", prose("ghijkl", 50, 5)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in langid.identify(docs, own).collect()}
    assert not got[0]["rejected"] and got[0]["lang_pred"] == "xa" and got[7]["lang_pred"] == "xb"
    assert got[1]["lang_pred"] == "xa" and got[1]["margin"] == 0 and got[1]["rejected"]
    assert [got[i]["lang_pred"] for i in (2, 3, 4, 5)] == ["und"] * 4 and got[6]["lang_pred"] != "und"
    assert {r["doc_id"] for r in langid.accepted(docs, own).collect()} == {0, 7}
    assert langid.accepted(docs, {}).count() == 0


def test_a_doc_id_on_very_many_rows_fills_no_sample(spark):
    rows = [(7, prose("abcdef", 3, k), "xa") for k in range(3000)] + [(8, prose("ghijkl", 50, 1), "xb")]
    found = langid.learn_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(found.get("xa", b"")) < 200 and "xb" in found
