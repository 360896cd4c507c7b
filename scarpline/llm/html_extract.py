"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a node with a hidden label, content or not. A node has a potential from its own features,
each parent-child edge has one from the kind of the child. Sum-product messages go up from the leaves and down from the
root and give each node's exact marginal; text whose element is more likely content than not is kept. The weights are
learned from labelled pages by gradient ascent on the likelihood, whose gradient are the same marginals.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.llm.common import rows_of

#: Fixed values of HTML: elements without content, with raw text, and those that start a block of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SECTION = frozenset("html head body address article aside dialog div fieldset footer form header main nav section".split())
HIDDEN = frozenset("head script style textarea title noscript iframe template select option svg math canvas object".split())
#: An opening tag of the key ends an open element of the values, up to the nearest element that holds them.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The end of a tag, or an attribute: a quote opens a value only right behind `=`, a value without quotes runs to white space or `>`.
ATTRIBUTE = re.compile(r"[\s/]*(?:(?P<end>>)|(?P<name>[^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?)")
NAMED = frozenset(("class", "id", "role", "data-main"))
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """The elements of a page in page order: parent index, tag, class words, label if any; texts as (element, text).

    Every character is looked at a bounded number of times, whatever the markup: a search that finds nothing ends the
    page or is never made again, and places of open elements are kept by tag.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.words, self.label, self.texts = [-1], ["#page"], [()], [False], []
        self._open_nodes, self._depths, self._blocks = [0], {}, []
        at, size = 0, len(source)
        while at < size:
            start = source.find("<", at)
            if start != at:
                self._text(html.unescape(source[at : start if start >= 0 else size]))
                if start < 0:
                    break
            at = self._markup(source, start)

    def _markup(self, source: str, start: int) -> int:
        """Reads the markup at start and gives the place behind it."""
        size, after = len(source), source[start + 1 : start + 2]
        ends = lambda mark, at: (found + len(mark)) if (found := source.find(mark, at)) >= 0 else size
        if source.startswith("<!--", start):
            return ends("-->", start + 2)
        if source.startswith("<![CDATA[", start):
            end = ends("]]>", start + 9)
            self._text(source[start + 9 : end].removesuffix("]]>"))
            return end
        if after in ("!", "?"):
            return ends(">", start)
        closing = after == "/"
        named = NAME.match(source, start + 1 + closing)
        if not named:
            self._text("<")
            return start + 1
        end, attributes, empty = self._attributes(source, named.end())
        if end < 0:  # a tag that never ends
            return size
        tag = named[0].lower()
        if closing:
            self._close(tag)
            return end
        self._imply(tag)
        self._open(tag, attributes)
        if tag == "br":
            self._text(" ")
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, end)
            return ends(">", close.end()) if close else size
        if tag not in VOID and not empty:
            self._push(tag)
        return end

    @staticmethod
    def _attributes(source: str, at: int) -> tuple[int, dict[str, str], bool]:
        """(the place behind the > that ends a tag, the named attributes, the first of equal names, whether `/` stands before the end); -1: no end.

        A quote that never closes is part of a value without quotes, so the rest of the page is searched for it once.
        """
        found: dict[str, str] = {}
        while m := ATTRIBUTE.match(source, at):
            at = m.end()
            if m["end"]:
                return at, found, m[0].endswith("/>")
            if (name := m["name"].lower()) in NAMED:
                found.setdefault(name, m[3] or m[4] or m[5] or "")
        return -1, found, False

    def _text(self, text: str) -> None:
        self.texts.append((self._open_nodes[-1], text))

    def _open(self, tag: str, named: dict[str, str]) -> None:
        parent = self._open_nodes[-1]
        self.parent.append(parent)
        self.tag.append(tag)
        self.words.append(tuple(w.lower() for k in ("class", "id", "role") if k in named for w in PART.findall(named[k])))
        self.label.append(self.label[parent] if "data-main" not in named else named["data-main"] == "1")

    def _push(self, tag: str) -> None:
        depth = len(self._open_nodes)
        self._open_nodes.append(len(self.tag) - 1)
        self._depths.setdefault(tag, []).append(depth)
        if tag in BLOCK:
            self._blocks.append(depth)

    def _cut(self, depth: int) -> None:
        """Closes the open elements from a depth on."""
        for node in reversed(self._open_nodes[depth:]):
            self._depths[self.tag[node]].pop()
        del self._open_nodes[depth:]
        while self._blocks and self._blocks[-1] >= depth:
            self._blocks.pop()

    def _depth(self, tags) -> int:
        """The depth of the innermost open element of some tags, 0 if there is none."""
        return max((own[-1] for t in tags if (own := self._depths.get(t))), default=0)

    def _close(self, tag: str) -> None:
        if depth := self._depth((tag,)):
            self._cut(depth)
        elif tag in ("p", "br"):  # as browsers do: an end tag alone is an empty element
            self._open(tag, {})

    def _imply(self, tag: str) -> None:
        if tag in BLOCK and self._blocks and self.tag[self._open_nodes[self._blocks[-1]]] == "p":
            self._cut(self._blocks[-1])  # a block ends an open paragraph, with all that is open in it
        if tag in ENDS and (depth := self._depth(ENDS[tag])) > self._depth(HOLDS[tag]):
            self._cut(depth)

    def features(self) -> list[list[str]]:
        n = len(self.tag)
        chars, linked, has_p, own_p = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in self.texts:
            chars[node] += len(text)
        in_link = [False] * n
        for k in range(1, n):
            in_link[k] = in_link[self.parent[k]] or self.tag[k] == "a"
        for k in range(n - 1, 0, -1):
            own_p[self.parent[k]] += self.tag[k] == "p"
            linked[k] += chars[k] if self.tag[k] == "a" else 0
            has_p[k] += self.tag[k] == "p"
            for own in (chars, linked, has_p):
                own[self.parent[k]] += own[k]
        out = []
        for k in range(n):
            share = linked[k] / chars[k] if chars[k] else 0.0
            out.append([f"tag {self.tag[k]}", f"size {min(int(math.log2(chars[k] + 1)) // 3, 3)}", f"links {int(share * 4)}", f"link {in_link[k]}", f"paragraphs {min(has_p[k], 3)}", f"own paragraphs {min(own_p[k], 3)}", *(f"word {w}" for w in dict.fromkeys(self.words[k]))])
        return out


def _softplus(x: float) -> float:
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


class Model:
    """Weights of features (log odds of content) and, by edge kind, the gain of agreeing labels (both content, neither)."""

    def __init__(self):
        self.own: dict[str, float] = {"bias": 0.0}
        self.edge: dict[str, list[float]] = {}

    @staticmethod
    def kind(page: Page, k: int) -> str:
        return "section" if page.tag[k] in SECTION else "block" if page.tag[k] in BLOCK else "inline"

    def marginals(self, page: Page, features: list[list[str]]) -> tuple[list[float], list[tuple[float, float]]]:
        """P(content) of each node; P(both content) and P(neither) of each node with its parent."""
        n, own = len(page.tag), self.own
        odds = [own["bias"] + sum(own.get(f, 0.0) for f in fs) for fs in features]
        gains = [self.edge.get(self.kind(page, k), (0.0, 0.0)) for k in range(n)]
        up, below = [0.0] * n, list(odds)  # messages as log odds
        for k in range(n - 1, 0, -1):
            both, neither = gains[k]
            up[k] = _softplus(below[k] + both) - (neither + _softplus(below[k] - neither))
            below[page.parent[k]] += up[k]
        belief, pairs = list(below), [(0.0, 0.0)] * n
        for k in range(1, n):
            both, neither = gains[k]
            above = belief[page.parent[k]] - up[k]  # of the parent without this child
            belief[k] = below[k] + _softplus(above + both) - (neither + _softplus(above - neither))
            logs = (neither, below[k], above, above + below[k] + both)  # neither, child alone, parent alone, both
            top = max(logs)
            total = sum(math.exp(x - top) for x in logs)
            pairs[k] = (math.exp(logs[3] - top) / total, math.exp(logs[0] - top) / total)
        return [_sigmoid(b) for b in belief], pairs

    def fit(self, pages: list[Page], rounds: int = 120, rate: float = 0.1, decay: float = 0.0002) -> Model:
        """Gradient ascent on the likelihood of the labels of all pages at once; messages pass level by level."""
        forest = _Forest(pages, self.kind)
        own, edge = np.zeros(len(forest.names)), np.zeros((len(forest.kinds), 2))
        speed_own, speed_edge = np.zeros_like(own), np.zeros_like(edge)
        for _ in range(rounds):
            for weights, gradient, speed in zip((own, edge), forest.gradients(own, edge), (speed_own, speed_edge)):
                gradient = gradient / len(forest.label) - decay * weights
                speed += 0.1 * (gradient * gradient - speed)
                weights += rate * gradient / (np.sqrt(speed) + 1e-4)
        self.own = dict(zip(forest.names, own.tolist()))
        self.edge = dict(zip(forest.kinds, edge.tolist()))
        return self


class _Forest:
    """The nodes of many pages as arrays, with their levels below the roots."""

    def __init__(self, pages: list[Page], kind):
        index, kinds = {"bias": 0}, {}
        parent, label, edges, level, node_of, feature_of = [], [], [], [], [], []
        for page in pages:
            base = len(parent)
            for k, features in enumerate(page.features()):
                parent.append(base + page.parent[k] if k else -1)
                level.append(level[parent[-1]] + 1 if k else 0)
                label.append(page.label[k])
                edges.append(kinds.setdefault(kind(page, k), len(kinds)))
                for f in ("bias", *features):
                    node_of.append(base + k)
                    feature_of.append(index.setdefault(f, len(index)))
        self.names, self.kinds = list(index), list(kinds)
        self.parent, self.label, self.edges = np.array(parent), np.array(label, float), np.array(edges)
        self.node_of, self.feature_of = np.array(node_of), np.array(feature_of)
        level = np.array(level)
        self.levels = [np.flatnonzero(level == d) for d in range(1, level.max(initial=0) + 1)]

    def gradients(self, own: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Labelled counts less expected ones, of features and of agreeing edges."""
        n = len(self.label)
        below = np.bincount(self.node_of, own[self.feature_of], n)
        both, neither = edge[self.edges].T
        soft = lambda x: np.logaddexp(0, x)
        up = np.zeros(n)
        for at in reversed(self.levels):
            up[at] = soft(below[at] + both[at]) - (neither[at] + soft(below[at] - neither[at]))
            np.add.at(below, self.parent[at], up[at])
        belief, above = below.copy(), np.zeros(n)
        for at in self.levels:
            above[at] = belief[self.parent[at]] - up[at]  # of the parent without this child
            belief[at] = below[at] + soft(above[at] + both[at]) - (neither[at] + soft(above[at] - neither[at]))
        miss = self.label - 1 / (1 + np.exp(-np.clip(belief, -500, 500)))
        to = np.concatenate([np.empty(0, int), *self.levels])
        logs = np.stack([neither[to], below[to], above[to], above[to] + below[to] + both[to]])
        shares = np.exp(logs - logs.max(0))
        shares /= shares.sum(0)
        a, b = self.label[to], self.label[self.parent[to]]
        pairs = [np.bincount(self.edges[to], a * b - shares[3], len(self.kinds)), np.bincount(self.edges[to], (1 - a) * (1 - b) - shares[0], len(self.kinds))]
        return np.bincount(self.feature_of, miss[self.node_of], len(self.names)), np.stack(pairs, 1)


def labelled_pages(n: int = 300, seed: int = 5) -> list[str]:
    """Pages of several invented layouts in which data-main="1" marks content and data-main="0" parts of it that are not.

    Among them are pages without a heading, without an element around the content, without a head and with bare markup.
    """
    rnd = random.Random(seed)
    words = "stone river light under maple carry seven glass narrow bright hill song paper late cloud".split()
    some = lambda a, b: " ".join(rnd.choice(words) for _ in range(rnd.randint(a, b)))
    links = lambda a, b: "".join(f'<li><a href="/{w}">{w}</a></li>' for w in some(a, b).split())
    off = lambda parts: "".join(re.sub(r"^<(\w+)", r"<\1 data-main='0'", x) for x in parts)
    pick = rnd.choice
    out = []
    for _ in range(n):
        if rnd.random() < 0.08:  # nothing but a little text
            out.append(f"<html><body data-main='1'>{pick([f'<p>{some(8, 60)}</p>', some(12, 90), f'<div>{some(12, 90)}</div>'])}</body></html>")
            continue
        body = []
        for _ in range(pick([0, 1, 1, 2, 3, 5, 8, 16, 30])):
            body.append(pick([f"<p>{some(1, 80)}.</p>", f"<p>{some(3, 90)}</p>", f"<p>{some(3, 300)}", f"<p><b>{some(1, 60)}<br>", f"<p><b>{some(1, 3)}<br>", f"<p>{some(300, 900)}</p>", f"<p>{some(5, 30)} <a href='/x'>{some(1, 3)}</a> <em>{some(1, 4)}</em> {some(4, 40)}</p>", f"<h2>{some(1, 6)}</h2><p>{some(9, 60)}</p>", f"<ul><li>{some(4, 20)}</li><li>{some(4, 20)}</li></ul>", f"<blockquote><p>{some(6, 40)}</p></blockquote>", f"<pre>{some(3, 30)}</pre>", f"<table><tr><td>{some(1, 5)}</td><td>{some(1, 5)}</td></tr></table>", f"<figure><figcaption>{some(3, 12)}</figcaption></figure>", f"<h3>{some(2, 6)}</h3><ol><li>{some(4, 20)}</ol>", f"<dl><dt>{some(1, 3)}<dd>{some(4, 20)}</dl>"]))
        if rnd.random() < 0.5:
            name = pick(["ad", "ads", "advert", "advertisement", "promo", "sponsored", "related", "share social", "newsletter signup", "banner", "notice", "cookie-notice", "author-box byline"])
            body.insert(rnd.randint(0, len(body)), f'<{(t := pick(["div", "aside", "section"]))} class="{name}" data-main="0"><p>{some(2, 30)}</p></{t}>')
        if rnd.random() < 0.2:
            body.insert(rnd.randint(0, len(body)), f'<aside data-main="0"><p>{some(4, 50)}</p></aside>')
        title = f"<h1>{some(1, 12)}</h1>" if rnd.random() < 0.65 or not body else ""
        bare = rnd.random() < 0.2
        main = "{}" if bare else pick(["<article data-main='1'>{}</article>", "<main data-main='1'>{}</main>", "<main><article data-main='1'>{}</article></main>", "<div id='content' class='main' data-main='1'>{}</div>", "<div class='post-content entry' data-main='1'>{}</div>", "<div class='article-body' data-main='1'>{}</div>", "<section role='main' data-main='1'>{}</section>", "<div class='container'><div class='story text' data-main='1'>{}</div></div>", "<div data-main='1'>{}</div>", "<div><div data-main='1'>{}</div></div>"])
        main = main.format(title + "".join(body))
        nav = pick([[], [f"<nav><ul>{links(3, 8)}</ul></nav>"], [f"<header><ul class='menu'>{links(3, 8)}</ul></header>"], [f"<header><h2>{some(1, 3)}</h2><p>{some(2, 9)}</p></header>", f"<div class='nav navbar'>{links(2, 7)}</div>"], [f"<div id='menu' role='navigation'>{links(2, 6)}</div>"], [f"<div class='breadcrumb'><a href='/'>{some(1, 2)}</a> {some(1, 3)}</div>"]])
        side = pick([[], [f"<aside><p>{some(4, 50)}</p></aside>"], [f"<div class='sidebar'><h3>{some(1, 3)}</h3><ul>{links(2, 6)}</ul><p>{some(3, 30)}</p></div>"], [f"<aside class='widget'>{some(4, 20)}</aside>"], [f"<div id='sidebar' role='complementary'><p>{some(4, 40)}</p></div>"]])
        advert = pick([[], [f"<div class='ad'>{some(2, 40)}</div>"], [f"<div class='advert'><p>{some(2, 40)}</p></div>"], [f"<div class='ads banner'><a href='/b'>{some(2, 20)}</a></div>"], [f"<section class='sponsored promo'><p>{some(4, 40)}</p></section>"]])
        notice = pick([[], [f"<div class='cookie-banner notice'><p>{some(4, 40)}</p><button>{some(1, 2)}</button></div>"], [f"<div id='consent' class='popup modal'>{some(4, 30)}</div>"], [f"<div role='alert' class='alert'>{some(2, 20)}</div>"], [f"<dialog><p>{some(4, 30)}</p></dialog>"], [f"<div class='notice'><p>{some(5, 40)}</p></div>"]])
        form = pick([[], [f"<form><label>{some(1, 4)}</label><input name='q'><button>{some(1, 2)}</button></form>"], [f"<form class='subscribe newsletter'><p>{some(3, 30)}</p><textarea>{some(1, 3)}</textarea></form>"], [f"<div class='search'><form><select><option>{some(1, 2)}</select></form></div>"]])
        talk = pick([[], [f"<section class='comments'><h2>{some(1, 3)}</h2>" + "".join(f"<div class='comment'><p>{some(3, 50)}</p></div>" for _ in range(rnd.randint(1, 4))) + "</section>"], ["<div id='comments'><ol>" + "".join(f"<li class='comment reply'><p>{some(3, 50)}</p>" for _ in range(rnd.randint(1, 4))) + "</ol></div>"], [f"<div id='disqus' class='discussion responses'><article class='comment'><p>{some(5, 60)}</p></article></div>"]])
        if talk and rnd.random() < 0.3:
            main, talk = main.replace("</article>", f"{off(talk)}</article>"), talk if "</article>" not in main else []
        foot = pick([[], [f"<footer>{some(2, 30)}</footer>"], [f"<footer><p>&copy; {some(2, 20)}</p><ul>{links(2, 5)}</ul></footer>"], [f"<div class='footer' id='footer'><p>{some(2, 30)}</p></div>"], [f"<div role='contentinfo' class='copyright'>{some(2, 12)}</div>"]])
        head = pick(["", f"<head><title>{some(2, 8)}</title></head>", f"<head><title>{some(2, 8)}</title><script>x(1)</script></head>"])
        inner = off(nav) + off(pick([advert + notice, notice, advert])) + main + off(talk) + off(side) + off(form) + off(foot)
        marked = " data-main='1'" if bare else ""
        out.append(pick(["<!DOCTYPE html><html>{}<body{}>{}</body></html>", "<html>{}<body{}>{}</body></html>"]).format(head, marked, inner))
    return out


@lru_cache(maxsize=1)
def default_model() -> Model:
    return Model().fit([Page(p) for p in labelled_pages()])


def main_text(source: str | None, model: Model) -> str:
    """The blocks of a page's content in page order, joined by newlines; white space in a block is one space."""
    if not source:
        return ""
    page = Page(source)
    belief, _ = model.marginals(page, page.features())
    n = len(page.tag)
    hidden, block = [False] * n, [0] * n
    for k in range(1, n):
        hidden[k] = hidden[page.parent[k]] or page.tag[k] in HIDDEN
        block[k] = k if page.tag[k] in BLOCK else block[page.parent[k]]
    blocks, own, held = [], None, []
    for node, text in page.texts:
        if hidden[node] or belief[node] < 0.5:
            continue
        if block[node] != own:
            blocks.append(held)
            own, held = block[node], []
        held.append(text)
    blocks.append(held)
    return "\n".join(t for t in (" ".join("".join(h).split()) for h in blocks) if t)


def _extracted(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for rows in rows_of(batches):
        texts = [main_text(h, model.value) for h in rows["html"]]
        yield pa.RecordBatch.from_arrays([pa.array(rows["page_id"], pa.int64()), pa.array(rows["url"], pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per page row: page_id, url, text (empty if there is none), n_chars (code points).

    model: fitted on labelled pages (Model().fit), else on the invented ones of labelled_pages(). A null or empty html
    has empty text; broken markup is read as browsers do, as far as it matters here. Whole pages are read, repeated
    rows give repeated rows, other columns are ignored and an empty table gives an empty one.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(lambda it: _extracted(it, sent), "page_id long, url string, text string, n_chars long")
