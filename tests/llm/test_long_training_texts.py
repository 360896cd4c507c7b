import random

from scarpline.llm import langid


def prose(letters, n, seed):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(3, 9))) for _ in range(n))


def test_a_language_of_long_documents_only_has_a_dictionary(spark):
    rows = [(1, prose("abcdef", 3000, 1), "xa"), (2, prose("ghijkl", 100, 2), "xb"), (3, prose("ghijkl", 90, 3), "xb")]
    assert len(rows[0][1]) > langid.SAMPLE_CHARS
    found = langid.learn_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(found) == {"xa", "xb"} and 0 < len(found["xa"]) <= 2 * (langid.SAMPLE_CHARS + langid.SAMPLE_CHARS // langid.SLICE_CHARS) + 1
    assert langid.Classifier(found).judge(" ".join(random.Random(4).sample(rows[0][1].split()[:1000], 50)))[0] == "xa"
