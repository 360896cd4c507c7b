import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from scarpline.llm import similar, simhash
from scarpline.llm.hamming import _merge


def shingled(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups_of(texts):
    """The least index of each text's group: chains of five-word Jaccard similarity of at least 0.8."""
    sets, root = [shingled(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def texts():
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(4000)}"
    passage, out = [word() for _ in range(60)], ["", " \t\n", "one", "One", "a b c d e", "a b c d e f"]
    for k in range(14):
        base = [word() for _ in range(rnd.choice([8, 40, 150, 600]))] + (passage if k % 2 else [])
        for c in range(6):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 35))):
                copy[rnd.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("common", [similar.COMMON, 2])
def test_groups_equal_brute_force(spark, common):
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "k long, text string")
    nodes, roots = similar.similar(docs, common)
    found = {}
    for r in nodes.join(roots, "node", "left").collect():
        found.setdefault(r["node"] if r["root"] is None else r["root"], []).append(r["k"])
    want = {}
    for i, g in enumerate(groups_of(rows)):
        want.setdefault(g, []).append(i)
    assert sorted(sorted(x) for x in found.values()) == sorted(want.values())
    assert len(want) < len({frozenset(shingled(t)) for t in rows})


def test_one_document_of_each_similar_group_stays(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, lang string")
    got = simhash.representatives(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(groups_of(rows))) and all(r["text"] == rows[r["doc_id"]] for r in got)
    assert simhash.representatives(docs.filter("false")).count() == 0


@pytest.mark.parametrize("tile", [similar.TILE, 3000])
def test_dense_clouds_of_near_copies(spark, tile):
    """Two texts with 250 copies each, of which many are not similar to one another, and no shingle with few sets."""
    rnd, rows = random.Random(12), []
    for k in range(2):
        base = [f"w{k} {i}".replace(" ", "x") for i in range(120)]
        for _ in range(250):
            copy = list(base)
            for at in rnd.sample(range(120), rnd.randint(0, 4)):
                copy[at] = f"n{rnd.randrange(3)}"
            rows.append(" ".join(copy))
    want = groups_of(rows)
    nodes, roots = similar.similar(spark.createDataFrame(list(enumerate(rows)), "k long, text string"), small=2, tile=tile)
    found = {}
    for r in nodes.join(roots, "node", "left").collect():
        found.setdefault(r["node"] if r["root"] is None else r["root"], []).append(r["k"])
    root = {k: min(ks) for ks in found.values() for k in ks}
    assert [root[i] for i in range(len(rows))] == want
    assert len([i for i in range(len(rows)) if want[i] != i]) > 300


@pytest.mark.parametrize("one_root", [True, False])
def test_tiles_lose_no_link(one_root):
    """One key of sets with 30 roots, of which the largest root only answers, or all ask: groups as from all pairs."""
    rng, seen = np.random.default_rng(3), 0
    groups = lambda links: _merge(np.arange(60), *np.array(links).T).tolist()
    for _ in range(8):
        sets, draw = [], lambda n: rng.integers(-(2**62), 2**62, int(n))
        bases = [draw(rng.integers(1, 900)) for _ in range(3)]
        for _ in range(60):
            base, part = bases[rng.integers(3)], rng.random() * 0.17
            sets.append(np.unique(np.r_[base[rng.random(len(base)) > part], draw(len(base) * part), base[:1]]))
        root = np.where(rng.random(60) < 0.4, 0, rng.integers(1, 30, 60))
        asks = root != 0 if one_root else np.ones(60, bool)
        rows = pa.table({"key": [1] * 60, "node": range(60), "root": root, "asks": asks, "grams": pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))})
        wide = pa.Table.from_batches(list(similar._wide(rows.select(["node", "grams"]).to_batches())))
        left = similar._tile_left(rows.drop(["grams"]).append_column("n", wide["n"]).append_column("bits", wide["bits"]))
        found = similar._tile_links(rows.filter(pc.is_in(rows["node"], left["node"])))
        pairs = [(i, j) for i in range(60) for j in range(i)]
        alike = {(i, j) for i, j in pairs if root[i] != root[j] and 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
        want = {(i, j) for i, j in alike if asks[i] != asks[j] or not one_root}
        got = {(max(p), min(p)) for p in zip(found["u"].to_pylist(), found["v"].to_pylist())}
        assert got <= alike
        trees = lambda links: groups([(i, j) for i, j in pairs if root[i] == root[j]] + sorted(links))
        assert trees(got) == trees(got | want)
        seen += len(want)
    assert seen > 100
