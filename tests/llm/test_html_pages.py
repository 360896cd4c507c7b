import html
import re
import time

import pytest

from scarpline.llm import html_extract

PARAGRAPH = "Some words of a plain paragraph that goes on for a while and ends after about a hundred characters. ok."
FIVE = f"<p>{PARAGRAPH}</p>" * 5
NAV = "<nav><ul><li><a href=/a>menu</a></li><li><a href=/b>other</a></li></ul></nav>"


@pytest.fixture(scope="module")
def model():
    return html_extract.default_model()


@pytest.mark.parametrize("page", [f"<html><body>{NAV}<div>{FIVE}</div></body></html>", f"<html><body>{FIVE}</body></html>", f"<body><article>{FIVE}</article><aside><p>side words go here</p></aside></body>", f"<html><body>{NAV}{FIVE}<footer>foot</footer></body></html>", f"<div>{FIVE}</div>", FIVE])
def test_plain_pages_give_their_paragraphs(model, page):
    assert html_extract.main_text(page, model) == "\n".join([PARAGRAPH] * 5)


def test_a_heading_stays(model):
    assert html_extract.main_text(f"<html><body>{NAV}<h1>T</h1>{FIVE}</body></html>", model) == "\n".join(["T"] + [PARAGRAPH] * 5)


@pytest.mark.parametrize("page", ["<p" * 200_000, "<p" * 200_000 + ">", "<div>" * 100_000 + "x", "<b>" * 50_000 + "<div></div>" * 50_000, "<div>" * 50_000 + "<li></li>" * 50_000, "<div>" * 50_000 + "</x>" * 50_000, "<script>" + "</script" * 100_000, '<a b="' * 100_000, "<!--" * 100_000, "<" * 200_000], ids=range(10))
def test_odd_markup_takes_linear_time(model, page):
    began = time.process_time()
    html_extract.main_text(page, model)
    assert time.process_time() - began < 20


def article(page):
    """The blocks of a page's article element, by regular expressions; these pages have one each, without boilerplate in it."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|blockquote|table|tr|td)\b[^>]*>", inner)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_pages_give_their_article_elements(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = html_extract.extract(rows).join(rows.select("page_id", "html"), "page_id").collect()
    assert len(got) == 2500
    assert sum(r["text"] == article(r["html"]) for r in got) / len(got) >= 0.995


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "u", f"<body>{FIVE}</body>", "x", 1), (1, "u", f"<body>{FIVE}</body>", "y", 2), (None, None, None, None, None)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 519, 519] and all(r.asDict().keys() == {"page_id", "url", "text", "n_chars"} for r in got)
