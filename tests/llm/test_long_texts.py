import pytest

import corpus_pipeline
from scarpline.llm import langid

LANGS = ("de", "en", "es", "fr")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(*corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def classifier(docs):
    return langid.Classifier(langid.learn_dictionaries(docs.filter(~langid.held_out())))


@pytest.mark.parametrize("lang", LANGS)
def test_a_very_long_document_keeps_its_language(docs, classifier, lang):
    texts = [r["text"] for r in docs.filter(langid.held_out()).filter(f"lang = '{lang}' AND n_chars BETWEEN 500 AND 20000").orderBy("doc_id").limit(600).collect()]
    text = "\n".join(texts)
    assert len(text) > 500_000
    for size in (100_000, 500_000, len(text)):
        found, _, margin = classifier.judge(text[:size])
        assert found == lang and margin >= 2 * langid.MIN_MARGIN
