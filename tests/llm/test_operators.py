import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
import xxhash

from scarpline.llm import decontam, html_extract, langid, line_dedup, media, packing, quality, simhash, substring, url_filter

EDGES = [(1, None), (2, ""), (3, "one"), (4, " \t\n "), (5, "word " * 30000), (6, "été Été \U0001f600"), (7, "one"), (7, "one"), (None, "no id")]


def frame(spark, rows, extra=True):
    """Documents with columns whose names clash with those that operators add."""
    names = "doc_id long, text string" + (", lang string, source string, n_lines long, span_id long, label string" if extra else "")
    return spark.createDataFrame([(*r, "en", "s", 9, 9, "x") if extra else r for r in rows], names)


def test_packing_is_whole_gapless_and_has_the_tokenizers_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(1)
    rows = [*EDGES, (8, " " * 1_000_000 + "x"), (9, "z" * 300_000), *[(100 + i, " ".join(rnd.choice(["stone", "don't", "río", "42", "\n\n", "  x", "<|endoftext|>", "a<|endoftext|>'s", "<|endoftext"]) for _ in range(rnd.randint(0, 1500)))) for i in range(60)]]
    out = packing.pack_documents(frame(spark, rows)).toPandas()
    ids = {}
    for doc_id, text in rows:
        ids[doc_id] = np.array([*own.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
    for r in out.itertuples():
        whole = ids[None if r.doc_id != r.doc_id else r.doc_id]
        assert zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.length == 1024 or r.piece == 0
    assert out.length.sum() == sum(len(ids[d]) for d, _ in rows)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *s.length.cumsum()][:-1] and s.length.sum() <= 1024
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 1024) + 1
    assert packing.pack_documents(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_and_is_near_the_least(seed):
    rnd = random.Random(seed)
    counts = {rnd.randint(1, 20): rnd.randint(1, 9) for _ in range(8)}
    plan = packing.plan_packing(counts, 20)
    used = {}
    for items, n in plan:
        assert sum(items) <= 20 and n > 0
        for k in items:
            used[k] = used.get(k, 0) + n
    assert used == counts
    total = sum(n for _, n in plan)
    assert total <= max(-(-sum(k * n for k, n in counts.items()) // 20), sum(n for k, n in counts.items() if k > 10)) * 1.25 + 1


@lru_cache(maxsize=None)
def fewest(items, capacity):
    """The least number of sequences for a sorted tuple of lengths, by trying every set with the largest one."""
    if not items:
        return 0
    largest, rest = items[-1], items[:-1]
    best = len(items)

    def fill(start, room, left):
        nonlocal best
        best = min(best, 1 + fewest(left, capacity))
        for i in range(start, len(left)):
            if left[i] <= room and (i == start or left[i] != left[i - 1]):
                fill(i, room - left[i], left[:i] + left[i + 1 :])

    fill(0, capacity - largest, rest)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_fixed_sets_are_dominant_and_plans_are_near_the_optimum(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 13, 20])
    items = sorted(rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9)))
    counts = Counter(items)
    best = fewest(tuple(items), capacity)
    assert best <= sum(n for _, n in packing.plan_packing(counts, capacity)) <= best + (best > 3)
    stock = packing._Stock(counts)
    fixed = packing._dominant(stock, stock.lengths[-1], capacity)
    if fixed:
        assert 1 + fewest(tuple(sorted((counts - Counter(fixed)).elements())), capacity) == best


def test_numbers_hold_whatever_the_size_of_groups(spark):
    docs = [(i % 7 if i % 5 else None, "stone " * (i % 9)) for i in range(400)]
    pieces = packing.stored(packing.token_pieces(spark.createDataFrame(docs, "doc_id long, text string"), 8))
    for rows in (1 << 18, 16):
        out = packing.pack(pieces, 8, rows).toPandas()
        assert len(out) == pieces.count()
        for _, s in out.sort_values("offset").groupby("sequence_id"):
            assert list(s.offset) == [0, *s.length.cumsum()][:-1] and s.length.sum() <= 8


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark):
    rnd = random.Random(2)
    base = [rnd.choice("abcdefghij") * 2 for _ in range(300)]
    rows = [r for r in EDGES if r[0] is not None]
    for i in range(40):
        words = list(base)
        for _ in range(i % 9):
            words[rnd.randrange(300)] = f"w{i}"
        rows.append((50 + i, " ".join(words)))
    rows += [(200 + i, " ".join(rnd.choice("klmnop") for _ in range(50))) for i in range(10)]
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    root[i] = min(root[i], root[j], key=lambda k: (rows[k][0], k))
    want = sorted((d, f"{f:016x}", rows[r][0]) for (d, _), f, r in zip(rows, fps, root))
    got = sorted(tuple(r) for r in simhash.op3_rows(frame(spark, rows)).collect())
    assert got == want
    assert simhash.op3_rows(frame(spark, [])).count() == 0


@pytest.mark.parametrize("group_rows", [2048, 40, 8])
def test_links_hold_whatever_the_group_bound(spark, group_rows):
    rnd = random.Random(3)
    fps = {rnd.getrandbits(63) for _ in range(20)}
    for x in list(fps)[:4]:
        for _ in range(60):
            y = x
            for _ in range(rnd.randint(1, 6)):
                y ^= 1 << rnd.randrange(63)
            fps.add(y)
    fps = sorted(fps)

    def groups(pairs):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        out = {}
        for x in fps:
            out.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    links = simhash.hamming_links(spark.createDataFrame([(x,) for x in fps], "fp long"), 4, group_rows).collect()
    assert groups(links) == groups((a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 4)


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcé ") for _ in range(rnd.randint(14, 24))).strip() for _ in range(12)]
    rows = [r for r in EDGES if r[0] is not None and r[0] != 7]
    for i in range(50):
        lines = []
        for _ in range(rnd.randint(1, 5)):
            line = rnd.choice(base)
            k = rnd.randrange(len(line))
            lines.append(rnd.choice([line, line[:k] + "Z" + line[k + 1 :], line[:k] + line[k + 1 :], line[:k] + "Y" + line[k:], f" {line}\r", ""]))
        rows.append((20 + i, "\n".join(lines)))
    seen, want = [], {}
    for doc_id, text in sorted(rows):
        kept, gone = [], 0
        for raw in (text or "").split("\n") if text is not None else []:
            line = raw.strip(" \t\r")
            if len(line) >= line_dedup.MIN_CHARS:
                if any(within_one(line, s) for s in seen):
                    gone += 1
                    seen.append(line)
                    continue
                seen.append(line)
            kept.append(raw)
        want[doc_id] = (0 if text is None else text.count("\n") + 1, gone, None if text is None else "\n".join(kept))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == want
    assert line_dedup.dedup_lines(frame(spark, EDGES)).count() == len(EDGES)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_media_round_trip(spark):
    got = media.op5_rows(frame(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    for r in got:
        data = next((t or "").encode() for d, t in EDGES if d == r["doc_id"])
        padded = data + bytes(-len(data) % 64) or bytes(64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
        stored = media.to_wav(data)
        assert media.from_wav(stored) == (media.RATE, padded) and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
    assert len({r["feature"] for r in got if r["doc_id"] in (3, 7)}) == 1
    assert media.op5_rows(frame(spark, [])).count() == 0


def test_url_rules(spark):
    urls = ["http://A.org/x", "https://example.org/es/a?b=/en/1", "http://m.Example.org/en/12", "http://b.com/fr/", "http://b.com/de/1", "http://b.net/", "http://org", "nothing", None, "x://h.org:80/y#z"]
    pages = spark.createDataFrame([(i, u, "<p>", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages).collect()}
    assert got[0] == ("a.org", "/x", "org/", "allow")
    assert got[1] == ("example.org", "/es/a", "example.org/es/", "block")
    assert got[2] == ("m.example.org", "/en/12", "example.org/en/1", "block")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5][2] is None and got[6] == ("org", "", None, got[6][3]) and got[7][:3] == ("", "", None) == got[8][:3]
    assert got[9][:2] == ("h.org:80", "/y")
    assert url_filter.judge_urls(pages.filter("false")).count() == 0


def test_distrust_flows_back_to_those_who_link(spark):
    link = '<a href="http://bad.com/x">x</a>'
    rows = [(1, "http://bad.com/de/1", ""), (2, "http://friend.net/a", link * 3), (3, "http://good.org/", '<a href="//liked.net/">l</a>'), (4, "http://liked.net/", None)]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2]["verdict"] == "block" and got[2]["distrust"] > 0
    assert got[4]["verdict"] == "allow" and got[4]["trust"] > 0


def test_html_keeps_the_article_only(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=/a>menu</a></ul></nav><div class='cookie-banner notice'><p>we use</p></div><div class=ad>buy</div><article><h1>A &amp;\n B</h1><p>First  text <b>bold</b> and <a href=x>link</a> words that go on.<p>Second&nbsp;one<br>here, with more words.</p><script>no('</p>')</script></article><section class=comments><h2>Comments</h2><div class=comment><p>me too</p></div></section><aside><p>side words</p></aside><form><label>name</label><button>send</button></form><footer>foot</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p" * 2000), (5, "u", "<div>" * 3000 + "x")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()}
    assert got[1][0] == "A & B\nFirst text bold and link words that go on.\nSecond one here, with more words."
    assert got[1][1] == len(got[1][0]) and got[2] == got[3] == ("", 0) and len(got) == 5
    assert html_extract.extract(pages.filter("false")).count() == 0


def test_html_model_on_unseen_pages():
    model, right, n = html_extract.default_model(), 0, 0
    for page in map(html_extract.Page, html_extract.labelled_pages(40, 77)):
        belief, _ = model.marginals(page, page.features())
        for node, text in page.texts:
            if text.strip():
                n, right = n + 1, right + ((belief[node] >= 0.5) == page.label[node])
    assert right / n > 0.98


def test_marginals_are_exact():
    model = html_extract.Model()
    rnd = random.Random(6)
    page = html_extract.Page("<div><p>a<b>c</b></p><ul><li>d</ul></div>")
    features = page.features()
    for fs in features:
        for f in fs:
            model.own[f] = rnd.uniform(-1, 1)
    model.edge = {k: [rnd.uniform(-1, 2), rnd.uniform(-1, 2)] for k in ("section", "block", "inline")}
    n, total, on = len(page.tag), 0.0, [0.0] * len(page.tag)
    for bits in range(1 << n):
        x = [bits >> k & 1 for k in range(n)]
        s = sum(x[k] * (model.own["bias"] + sum(model.own[f] for f in features[k])) for k in range(n))
        for k in range(1, n):
            both, neither = model.edge[model.kind(page, k)]
            s += both if x[k] and x[page.parent[k]] else neither if not x[k] and not x[page.parent[k]] else 0
        w = np.exp(s)
        total += w
        for k in range(n):
            on[k] += w * x[k]
    assert model.marginals(page, features)[0] == pytest.approx([o / total for o in on])


def plain_repeats(rows, window):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone |= set(range(i, i + window))
            seen.add(key)
        out[doc_id] = (" ".join(w for i, w in enumerate(words) if i not in gone), len(words), len(gone))
    return out


@pytest.mark.parametrize("places", [4096, 3])
def test_substring_dedup_equals_brute_force(spark, places):
    rnd = random.Random(7)
    base = [rnd.choice("abcdefgh") for _ in range(60)]
    rows = [r for r in EDGES if r[0] is not None and r[0] != 7]
    for d in range(60):
        a = rnd.randint(0, 40)
        noise = lambda: [rnd.choice("xyz") for _ in range(rnd.randint(0, 9))]
        rows.append((20 + d, " ".join(rnd.choice([[rnd.choice("ab") for _ in range(40)], noise() + base[a : a + rnd.randint(5, 40)] + noise() + base[: rnd.randint(0, 20)], base]))))
    got = {r["doc_id"]: (r["text"], r["n_words"], r["n_removed"]) for r in substring.remove_repeats(frame(spark, rows), 8, 3, places).collect()}
    assert got == plain_repeats(rows, 8)
    assert substring.op8_rows(frame(spark, EDGES)).count() == len(EDGES)
    assert substring.op8_rows(frame(spark, [])).count() == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op9_rows(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    edges = langid.op9_rows(frame(spark, EDGES)).collect()
    assert {r["lang_pred"] for r in edges if r["doc_id"] in (1, 2, 4)} == {"und"} and len(edges) == len(EDGES)
    assert langid.op9_rows(frame(spark, [])).count() == 0


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["a", "b", "c", "Dé", "9"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 7, 10, 14, 30])] + [(7, None), (8, "..."), (10, "A b")]
    docs = [(d, t) for d, t in EDGES if d not in (None, 7)] + [(20 + d, rnd.choice([" ", "-", "\n"]).join([word() for _ in range(rnd.randint(0, 12))] + (items[rnd.randrange(7)][1] or "").upper().split() + [word()])) for d in range(50)]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    for part in (items, items[3:7]):
        want = {}
        for d, text in docs:
            words, hit, found = split(text), set(), set()
            for k, t in part:
                item = split(t)
                runs = {tuple(item[i : i + 10]) for i in range(max(1, len(item) - 9))} if item else set()
                for run in runs:
                    for i in range(len(words) - len(run) + 1):
                        if tuple(words[i : i + len(run)]) == run:
                            hit |= set(range(i, i + len(run)))
                            found.add(str(k))
            want[d] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
        bench = spark.createDataFrame(part, "item_id long, text string")
        got = {r[0]: tuple(r)[1:] for r in decontam.op10_rows(frame(spark, docs), bench).collect()}
        assert got == want
    bench = spark.createDataFrame(items, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.op10_rows(frame(spark, EDGES), none).filter("contaminated").count() == 0
    assert decontam.op10_rows(frame(spark, EDGES), bench).count() == len(EDGES)
    assert decontam.op10_rows(frame(spark, []), bench).count() == 0


def test_quality_of_held_out_documents(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = quality.score_documents(docs, labels).join(labels.withColumnsRenamed({"quality": "q", "toxic": "t"}), "doc_id").collect()
    assert sum((r["quality"] >= 0.5) == (r["q"] == 1) for r in got) / len(got) > 0.93
    assert sum((r["toxic"] >= 0.5) == (r["t"] == 1) for r in got) / len(got) > 0.93


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score_documents(frame(spark, EDGES), none).count() == len(EDGES)
    assert quality.score_documents(frame(spark, []), none).count() == 0
