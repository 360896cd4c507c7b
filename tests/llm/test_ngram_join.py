"""The n-gram join against all pairs in plain Python, and its keys against every pair of sets that is alike enough."""

import os
import random

import duckdb
import numpy as np
import pytest

from scarpline.llm import ngram_join, similar
from test_similar import groups_of, shingled, texts

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_sets_alike_enough_share_a_key():
    """Sets at the limit, with any share of rare, common and very common shingles."""
    rng, met = np.random.default_rng(2), 0
    for _ in range(1500):
        n = int(rng.choice([4, 5, 6, 8, 10, 31, 40, 64, 79, 80, 130, 500, 1300]))
        pool = np.unique(rng.integers(-(2**62), 2**62, 2 * n + 8))
        share = rng.random(2) * rng.choice([0, 1, 1])
        kind = np.where(rng.random(len(pool)) < share[0], 1 + (rng.random(len(pool)) < share[1]), 0)
        some = rng.permutation(pool)
        extra = int(rng.integers(0, n // 4 + 1))
        gone = 0
        while 5 * (n - gone - 1) >= 4 * (n + extra):
            gone += 1
        if 5 * (n - gone) < 4 * (n + extra):
            continue
        x = np.sort(some[:n])
        y = np.sort(np.r_[some[gone:n], some[n : n + extra]])
        a, b = (similar.signature(s, similar.Frequent(pool[kind == 1], pool[kind == 2])) for s in (x, y))
        assert 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y))
        assert len(np.intersect1d(a, b)) > 0, (n, extra, gone)
        met += 1
    assert met > 1000


def test_shingles_are_the_sets_of_the_contract():
    for text in texts() + ["a" * 65 + " " + "A" * 65 + " b c d e f", "a" * 64 + "b c d e f g " * 3, "\x1ca b\xa0c d e f", "A\tb\nc\x0bd\x0ce\rf", "É é É é É é"]:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        split = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in words).split(" ") if w]
        want = {tuple(split[i : i + 5]) for i in range(max(1, len(split) - 4))} if split else set()
        assert len(similar.shingles(text)) == len(want)


@pytest.mark.parametrize("settings", [{}, {"common": 2}, {"common": 1, "very_common": 3}, {"common": 1, "very_common": 1, "small": 2, "tile": 3000}])
def test_documents_equal_brute_force(spark, monkeypatch, settings):
    rows = texts()
    pick = random.Random(4)
    rows += pick.sample(rows, 20) + [None, "Only four words here", "only Four words here", "w " * 200_000, "w " * 150_000]
    want = groups_of([r or "" for r in rows])
    real = similar.similar
    monkeypatch.setattr(ngram_join, "similar", lambda docs: real(docs, **settings))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS root", "3 AS t1", "4 AS node")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op11_rows(docs).collect()}
    sets = [shingled(r or "") for r in rows]
    assert got == {i: (len(s), want[i] if s else i) for i, s in enumerate(sets)}


def test_missing_and_repeated_ids(spark):
    a, b = " ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(30))
    rows = [(5, a), (5, b), (None, a), (None, "own words"), (3, b), (3, b), (9, None), (9, "")]
    got = [tuple(r) for r in ngram_join.op11_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(5, 26, 5), (5, 26, 3), (None, 26, 5), (None, 1, None), (3, 26, 3), (3, 26, 3), (9, 0, 9), (9, 0, 9)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert ngram_join.op11_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the tables")
def test_whole_table_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}'")
    want = con.execute(ngram_join.OP11_SQL).fetchall()
    got = [tuple(r) for r in ngram_join.op11_rows(spark.read.parquet(DATA)).collect()]
    assert len(want) == 1000 and sorted(got) == sorted(want)
