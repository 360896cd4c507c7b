"""Collocations against plain Python, with names that go to every task and with names that are joined."""

import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from scarpline.llm import collocations as cl

DATA = "/root/testdata/sf0.01/documents.parquet"


def plain(rows, max_words=5, min_count=100, percent=100, keep=2000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = lang or "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        often = {p: c for p, c in own.items() if c >= min_count}
        inside = defaultdict(int)
        for p, c in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], c)
        found = []
        for p, a in often.items():
            if len(p) > 1 and 100 * inside[p] < percent * a:
                cuts = [(1000 * a * n[lang] // (own[p[:j]] * own[p[j:]]), j, own[p[:j]], own[p[j:]]) for j in range(1, len(p))]
                score, _, l, r = min(cuts)  # noqa: E741
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:keep], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def rows_like_text(seed=1):
    pick = random.Random(seed)
    words = ["Aa", "bB", "c", "d", "é", "EÉ", "日本", "x\x1cy", "\xa0z", "\x00"]
    rows = [(None, "en"), ("", "en"), (" \t.,", None), ("Aa bB c d é Aa bB c d é", ""), ("one " * 3000, None), ("tie two. tie two. tie two. tie two", "de")]
    for _ in range(300):
        n = pick.randint(0, 30)
        sep = ["  ", " ", "\t", " ", ", ", ". ", "\n", "\r\n", "\x0b", "! ", "?", ";", ":"]
        rows.append(("".join(pick.choice(words) + pick.choice(sep) for _ in range(n)), pick.choice(["en", "en", "en", "de", None, ""])))
    return rows + rows[:50]


@pytest.mark.parametrize("settings", [{}, {"names_bytes": 0}, {"max_words": 3, "percent": 60, "keep": 7}])
def test_phrases_equal_plain_python(spark, settings):
    rows = rows_like_text()
    percent = settings.pop("percent", 100)
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS id", "'x' AS phrase", "2 AS f")
    got = cl.collocations(df, min_count=4, subsumed_percent=percent, **settings)
    limits = {k: v for k, v in settings.items() if k != "names_bytes"}
    want = plain(rows, min_count=4, percent=percent, **limits)
    assert len(want) > 20 and sorted(map(tuple, got.collect())) == want


def test_scores_beyond_64_bits_are_exact(spark):
    row = spark.createDataFrame([(10**14, 10**14, [10**14, 10**14], [10**12, 10**14])], "f long, n long, starts array<long>, ends array<long>")
    assert row.select(cl._cut(2).alias("c")).select("c.score").first()[0] == 1000 * 10**28 // 10**26


def test_empty_table(spark):
    assert cl.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the tables")
def test_whole_table_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}'")
    want = con.execute(cl.OP12_SQL).fetchall()
    got = list(map(tuple, cl.op12_rows(spark.read.parquet(DATA)).collect()))
    assert len(want) > 50 and sorted(got) == sorted(want)
    rows = spark.read.parquet(DATA).select("text", "lang").collect()
    assert sorted(got) == plain(map(tuple, rows))
