"""Attributes of tags with stray quotes, against a state machine written out."""

import random
import time

from scarpline.llm import html_extract as he


def states(source):
    """(end, class) of the tag whose name ends before source: the states of the HTML standard, one character at a time."""
    state, name, value, found = "before", "", "", {}

    def done():
        found.setdefault(name.lower(), value)

    for i, c in enumerate(source):
        if state == "before":
            if c == ">":
                return i + 1, found
            if not c.isspace() and c != "/":
                state, name, value = "name", c, ""
        elif state in ("name", "after name"):
            if c == ">":
                done()
                return i + 1, found
            if c == "/":
                done()
                state = "before"
            elif c.isspace():
                state = "after name"
            elif c == "=":
                state = "before value"
            elif state == "after name":
                done()
                state, name, value = "name", c, ""
            else:
                name += c
        elif state == "before value":
            if c == ">":
                done()
                return i + 1, found
            if c in "\"'":
                state = c if c in source[i + 1 :] else "bare"
                value = "" if state == c else c
            elif not c.isspace():
                state, value = "bare", c
        elif state == "bare":
            if c == ">" or c.isspace():
                done()
                if c == ">":
                    return i + 1, found
                state = "before"
            else:
                value += c
        elif c == state:
            done()
            state = "before"
        else:
            value += c
    return -1, found


def test_tags_end_where_the_states_say():
    pick = random.Random(8)
    parts = ["\"", "'", ">", "/", " ", "=", "class", "id", "a", "\n", "class=\"x\"", "id='y'", "=\"", "='", "b c", " class=z"]
    ended = 0
    for _ in range(20_000):
        source = "".join(pick.choices(parts, k=pick.randint(0, 12)))
        end, named, _ = he.Page._attributes(" " + source, 1)
        want, found = states(source)
        assert end == (want + 1 if want >= 0 else -1), source
        if want >= 0:
            ended += 1
            assert named == {k: v for k, v in found.items() if k in he.NAMED}, source
    assert ended > 5000


def test_pages_with_stray_quotes_keep_their_text():
    body = "".join(f"<p>Paragraph number {i} of this article has a good many words in it, and then a few more.</p>" for i in range(5))
    want = he.main_text(f"<article><h1>T</h1><div class='a'>{body}</div></article><footer class='f'>foot</footer>", he.default_model())
    for div in ("<div class=\"a\"\">", "<div class=a\">", "<div title=don't>", "<div class='a' '>", "<div \" class=a>"):
        for foot in ("<footer class=\"f\">foot</footer>", "<footer class=\"f\">it's <b class='x'>foot</b></footer>"):
            page = f"<article><h1>T</h1>{div}{body}</div></article>{foot}"
            assert he.main_text(page, he.default_model()) == want, div
    image = f"<article><h1>T</h1><img alt=don't><div>{body}</div></article>"
    assert he.main_text(image, he.default_model()).count("Paragraph") == 5


def test_stray_quotes_take_linear_time():
    began = time.time()
    for unit in ("<p class=\"", "<p '\" ", "<p a=' ", "<p a =", "<p    ", "<a b=\"c\"\"", "\"'=<"):
        he.Page(unit * 60_000)
    assert time.time() - began < 30
