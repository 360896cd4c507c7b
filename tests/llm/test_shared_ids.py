"""Rows that share a doc_id, or have none, in line and substring dedup: each row is a document, as plain Python has it."""

import random

from scarpline.llm import line_dedup, substring

LAST = (1 << 63) - 1


def rows_of(pick, unit):
    """Documents that take passages from one another, of repeated, missing and shared doc_ids, some of them repeated rows."""
    fresh = iter(range(10**6))
    passages = [[f"p{k}{unit}{i}" for i in range(14)] for k in range(6)]
    out = [(None, None), (3, None), (3, ""), (None, "")]
    for _ in range(60):
        words = []
        for _ in range(pick.randint(1, 4)):
            words += pick.choice(passages)[: pick.randint(6, 14)] if pick.random() < 0.5 else [f"w{next(fresh)}" for _ in range(pick.randint(3, 12))]
        out.append((pick.choice([None, 1, 1, 2, 3, 4, 5, 5, 5, 9]), unit.join(words)))
    return out + pick.sample(out, 8)


def order(spark, rows):
    """(number, hash of the text) of each row."""
    hashes = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "i long, text string").selectExpr("i", "xxhash64(text) AS h").collect()
    by = {r.i: r.h for r in hashes}
    return [(LAST if d is None else d, by[i]) for i, (d, _) in enumerate(rows)]


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_lines_of_rows(spark):
    pick = random.Random(4)
    rows = [(d, t and "\n".join(f"Line of {w}, and its end" if k % 5 else f"Line of {w}, and it end" for k, w in enumerate(t.split(" ")))) for d, t in rows_of(pick, " ")]
    at = order(spark, rows)
    places = {(key, k, line.strip(" \t\r")) for key, (_, t) in zip(at, rows) if t is not None for k, line in enumerate(t.split("\n"))}
    gone = {(key, k) for key, k, line in places if len(line) >= 16 and any(len(o) >= 16 and (k2, j) < (key, k) and near(o, line) for k2, j, o in places)}
    want = [(d, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (key, k) not in gone)) for key, (d, t) in zip(at, rows)]
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(gone) > 30 and sorted(map(str, got)) == sorted(map(str, want))


def test_a_unique_row_of_a_shared_id_stays_whole(spark):
    line = "a line that is repeated in two of the rows"
    rows = [(0, line), (1, line + "\nunique tail"), (1, "an entirely unique first line\nand a second unique one")]
    got = sorted(r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([line, "unique tail", rows[2][1]])
    words = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("w", 25), ("q", 27))]
    rows = [(0, words[0]), (1, words[0] + " x y"), (1, words[1])]
    got = sorted(r.text for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([words[0], "x y", words[1]])


def test_windows_of_rows(spark):
    pick = random.Random(6)
    rows, window = rows_of(pick, " "), 5
    at = order(spark, rows)
    first = {}
    for key, (_, t) in sorted(zip(at, rows), key=lambda x: x[0]):
        w = (t or "").split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (key, i))
    want, removed = [], 0
    for key, (d, t) in zip(at, rows):
        w = (t or "").split()
        gone = {k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < (key, i) for k in range(i, i + window)}
        removed += len(gone)
        want.append((d, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    for places in (4096, 2):
        got = [tuple(r) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window, 3, places).select("doc_id", "text", "n_words", "n_removed").collect()]
        assert removed > 100 and sorted(map(str, got)) == sorted(map(str, want))
