import random

import pytest

from scarpline.llm import line_dedup


def docs_of(spark, lines):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")


def removed(spark, lines):
    return {r["doc_id"] for r in line_dedup.dedup_lines(docs_of(spark, lines)).filter("n_removed > 0").collect()}


def edited(line, k, how):
    return {"change": line[:k] + "#" + line[k + 1 :], "drop": line[:k] + line[k + 1 :], "add": line[:k] + "#" + line[k:]}[how]


@pytest.mark.parametrize("how", ["change", "drop", "add"])
def test_edits_at_every_place_of_lines_of_several_blocks(spark, monkeypatch, how):
    monkeypatch.setattr(line_dedup, "MIN_BLOCK", 4)
    rnd, lines, want = random.Random(1), [], set()
    for n in (16, 17, 23, 24, 31, 32, 33, 63, 64, 65, 90, 91):
        for k in [*range(n), *([n] if how == "add" else [])]:
            line = "".join(rnd.choice("abcdé \U0001f600") for _ in range(n - 2))
            line = f"x{line}y"
            lines += [line, edited(line, k, how)]
            want.add(len(lines) - 1)
            if how != "add":
                lines.append(edited(edited(line, k, how), (k + n // 2) % (n - 1), how))  # two edits from the first line, one from the second
                want.add(len(lines) - 1)
    got = removed(spark, lines)
    seen, brute = [], set()
    within = lambda a, b: a == b or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= 1) or (abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(max(len(a), len(b)))))
    for i, raw in enumerate(lines):
        line = raw.strip(" \t\r")
        if len(line) >= line_dedup.MIN_CHARS:
            if any(within(line, s) for s in seen[-4:]):
                brute.add(i)
            seen.append(line)
    assert got == brute and len(got) > len(want) * 0.8


def test_two_very_long_lines_one_edit_apart(spark):
    rnd = random.Random(2)
    line = "".join(rnd.choice("abcdefgh ") for _ in range(200_000))
    line = f"x{line}y"
    assert removed(spark, [line, edited(line, 150_000, "change"), edited(line, 20, "drop"), edited(line, 150_000, "drop")]) == {1, 2, 3}


def test_one_line_on_most_rows(spark):
    hot = "a line that stands in very many documents"
    assert removed(spark, [hot if i % 3 else f"line number {i} of the others {i * i}" for i in range(3000)]) == {i for i in range(2, 3000) if i % 3}
