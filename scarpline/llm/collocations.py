"""Collocations by hierarchical pair naming.

Frequent words get ids. In every round two adjacent ids of k-1 words, which overlap in all but their first and last word, are a
pair; pairs are counted over the whole corpus, the frequent ones get ids of their own, and these replace them in the documents.
A phrase is frequent only if both its halves of a pair are, so nothing else is ever counted. Each id's pair is a pair of parent
pointers as well: the ones on the left lead to the counts of what a phrase begins with, those on the right to what it ends
with, and a phrase lies inside a longer one if it is a parent of one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarpline.llm.common import discard, rows_of, stored

MAX_WORDS, MIN_COUNT, SUBSUMED_PERCENT, KEEP = 5, 100, 100, 2000
#: Names of at most so many bytes go to every task; more are joined by a shuffle.
NAMES_BYTES = 16 << 20
#: Counts that a task holds before it sends them on.
HELD_WORDS, HELD_PAIRS = 500_000, 1 << 21
SALTS = 64
#: A byte that no UTF-8 text has; it stands where a piece ends.
BREAK = b"\xff"
_BYTES = bytes(255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
SEQUENCES = "row long, places array<int>, ids array<long>"


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased (A-Z), with a BREAK wherever a piece ends."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).replace(BREAK, b" \xff ").split()


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (lang, word, n) of words, and with a null word of all words of a language, each summed over a part of a task's rows."""
    held: dict[str, Counter] = {}

    def sent():
        langs, words, counts = [], [], []
        for lang, own in held.items():
            own.pop(BREAK, None)
            langs += [lang] * (len(own) + 1)
            words += [None, *own]
            counts += [sum(own.values()), *own.values()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "word", "n"])

    for rows in rows_of(batches):
        for lang, text in zip(rows["lang"], rows["text"]):
            held.setdefault(lang, Counter()).update(tokens(text))
            if len(held[lang]) > HELD_WORDS:
                yield sent()
        if sum(map(len, held.values())) > HELD_WORDS:
            yield sent()
    if held:
        yield sent()


def _sequences(rows: list[int], places: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    ends = pa.array(np.cumsum([0, *map(len, places)]), pa.int32())
    whole = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(whole(places, np.int32))), pa.ListArray.from_arrays(ends, pa.array(whole(ids, np.int64)))], ["row", "places", "ids"])


def _word_ids(batches: Iterable[pa.RecordBatch], names) -> Iterator[pa.RecordBatch]:
    known = names.value
    for rows in rows_of(batches):
        out = [], [], []
        for row, lang, text in zip(rows["row"], rows["lang"], rows["text"]):
            get = known.get(lang, {}).get
            ids = np.array([get(w, -1) for w in tokens(text)], np.int64)
            places = np.flatnonzero(ids >= 0)
            if len(places) > 1:
                for column, value in zip(out, (row, places, ids[places])):
                    column.append(value)
        yield _sequences(*out)


def _word_places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in rows_of(batches):
        for row, lang, text in zip(rows["row"], rows["lang"], rows["text"]):
            words = tokens(text)
            if words:
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(words), pa.int64()), pa.array(range(len(words)), pa.int32()), pa.array([lang] * len(words), pa.string()), pa.array([None if w == BREAK else w for w in words], pa.binary()).cast(pa.string())], ["row", "place", "lang", "word"])


def _adjacent(rows: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the document, place, left id, right id) of the adjacent ids of a batch of sequences."""
    sizes = rows["places"].value_lengths().to_numpy()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    places, ids = rows["places"].flatten().to_numpy(), rows["ids"].flatten().to_numpy()
    at = np.flatnonzero((owner[1:] == owner[:-1]) & (places[1:] == places[:-1] + 1))
    return owner[at], places[at], ids[at], ids[at + 1]


def _columns(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            yield dict(zip(part.schema.names, part.columns))


def _pair_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def sent():
        left, right = (np.concatenate(side) for side in zip(*held))
        held.clear()
        known, index = np.unique(np.concatenate([left, right]), return_inverse=True)
        keys, n = np.unique(index[: len(left)] * len(known) + index[len(left) :], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(known[keys // len(known)]), pa.array(known[keys % len(known)]), pa.array(n, pa.int64())], ["left", "right", "n"])

    for rows in _columns(batches):
        _, _, left, right = _adjacent(rows)
        held.append((left, right))
        size += len(left)
        if size > HELD_PAIRS:
            yield sent()
            size = 0
    if size:
        yield sent()


class _PairNames:
    """Ids of pairs, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, ids: np.ndarray):
        self.lefts, a = np.unique(left, return_inverse=True)
        self.rights, b = np.unique(right, return_inverse=True)
        keys = a * len(self.rights) + b
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices of the pairs that have an id, their ids)."""
        a, b = (np.minimum(np.searchsorted(known, x), len(known) - 1) for known, x in ((self.lefts, left), (self.rights, right)))
        keys = a * len(self.rights) + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero((self.lefts[a] == left) & (self.rights[b] == right) & (self.keys[at] == keys))
        return hit, self.ids[at[hit]]


def _pair_ids(batches: Iterable[pa.RecordBatch], names) -> Iterator[pa.RecordBatch]:
    known = _PairNames(*names.value)
    for rows in _columns(batches):
        owner, places, left, right = _adjacent(rows)
        hit, ids = known.find(left, right)
        docs, first = np.unique(owner[hit], return_index=True)
        yield _sequences(rows["row"].to_numpy()[docs].tolist(), np.split(places[hit], first[1:]) if len(first) else [], np.split(ids, first[1:]) if len(first) else [])


def _pair_places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _columns(batches):
        owner, places, left, right = _adjacent(rows)
        yield pa.RecordBatch.from_arrays([pa.array(rows["row"].to_numpy()[owner], pa.int64()), pa.array(places, pa.int32()), pa.array(left), pa.array(right)], ["row", "place", "left", "right"])


def _gathered(placed: DataFrame) -> DataFrame:
    """Sequences of rows (row, place, id); each holds no more than its document has words."""
    by_row = placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("x"))
    return by_row.select("row", F.col("x.place").alias("places"), F.col("x.id").alias("ids"))


def _named(counts: DataFrame, min_count: int, *kept: str) -> DataFrame:
    """The frequent rows of counts with ids, stored: one id for each, whoever reads it."""
    return stored(counts.filter(F.col("f") >= min_count).select(F.monotonically_increasing_id().alias("id"), *kept, "f"))


def _with_word_ids(texts: DataFrame, names: DataFrame, names_bytes: int) -> DataFrame:
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    held = names.agg(F.sum(F.octet_length("word") + 32)).first()[0] or 0
    if held > names_bytes:
        placed = rows.mapInArrow(_word_places, "row long, place int, lang string, word string").filter("word IS NOT NULL")
        return stored(_gathered(placed.join(names.select("lang", "word", "id"), ["lang", "word"]).select("row", "place", "id")))
    known: dict[str, dict[bytes, int]] = {}
    for r in names.select("lang", F.col("word").cast("binary").alias("word"), "id").toArrow().to_pylist():
        known.setdefault(r["lang"], {})[r["word"]] = r["id"]
    shared = texts.sparkSession.sparkContext.broadcast(known)
    return stored(rows.mapInArrow(lambda it: _word_ids(it, shared), SEQUENCES))


def _with_pair_ids(sequences: DataFrame, names: DataFrame, names_bytes: int) -> DataFrame:
    if 24 * names.count() > names_bytes:
        placed = sequences.mapInArrow(_pair_places, "row long, place int, left long, right long")
        return stored(_gathered(placed.join(names.select("left", "right", "id"), ["left", "right"]).select("row", "place", "id")))
    found = names.select("left", "right", "id").toArrow()
    shared = sequences.sparkSession.sparkContext.broadcast(tuple(found.column(c).to_numpy() for c in ("left", "right", "id")))
    return stored(sequences.mapInArrow(lambda it: _pair_ids(it, shared), SEQUENCES))


def phrases(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, names_bytes: int = NAMES_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """(totals (lang, n), [frequent phrases of 1, 2, ... max_words words]) of rows (text, lang).

    Phrases have id, lang, phrase, last (its last word), f, starts and ends (f of its first and of its last 1, 2, ... words, itself
    included), and from two words on left and right, the ids of it without its last and without its first word. Names of more than
    names_bytes bytes are joined to the documents by a shuffle instead of going to every task; the result is the same.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    counts = texts.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    words = _named(counts, 1 if min_count < 1 else min_count, "lang", "word")
    # a total under min_count has no frequent word behind it either
    totals, names = words.filter("word IS NULL").select("lang", F.col("f").alias("n")), words.filter("word IS NOT NULL")
    levels = [names.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("starts"), F.array("f").alias("ends"))]
    sequences = _with_word_ids(texts, names, names_bytes)
    for k in range(2, max_words + 1):
        pairs = _named(sequences.mapInArrow(_pair_counts, "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("f")), min_count, "left", "right")
        a, b = levels[-1].select(F.col("id").alias("left"), "lang", "phrase", "starts"), levels[-1].select(F.col("id").alias("right"), "last", "ends")
        both = pairs.join(a, "left").join(b, "right")
        grown = lambda c: F.concat(c, F.array("f")).alias(c)
        levels.append(stored(both.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", grown("starts"), grown("ends"), "left", "right")))
        if k < max_words:
            old, sequences = sequences, _with_pair_ids(sequences, pairs, names_bytes)
            discard(old)
        discard(pairs)
    discard(sequences)
    return totals, levels


def _cut(k: int) -> Column:
    """The cut (score, words before it, l, r) of the lowest score of a phrase of k words, of equals the first."""
    exact = lambda c: c.cast("decimal(38,0)")
    cuts = [(F.col("starts")[j - 1], F.col("ends")[k - j - 1], j) for j in range(1, k)]
    score = lambda l, r: F.expr(f"(CAST(1000 AS DECIMAL(4,0)) * CAST(f AS DECIMAL(17,0)) * CAST(n AS DECIMAL(15,0))) div (CAST(starts[{l}] AS DECIMAL(18,0)) * CAST(ends[{r}] AS DECIMAL(18,0)))")  # noqa: E731,E741
    return F.array_min(F.array(*[F.struct(score(j - 1, k - j - 1).alias("score"), F.lit(j).alias("words"), l.alias("l"), r.alias("r")) for l, r, j in cuts]))  # noqa: E741


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, subsumed_percent: int = SUBSUMED_PERCENT, keep: int = KEEP, names_bytes: int = NAMES_BYTES) -> DataFrame:
    """The `keep` best phrases of each language of rows (text, lang): lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut into pieces at `.,;:!?` and line ends, words lie between spaces and tabs. Phrases of two to
    max_words words that occur at least min_count times count (a). A cut into l times something and r times something scores
    floor(1000 a n / (l r)) with n words in the language; a phrase has the score of its lowest cut, of equal ones the first. Phrases
    inside a longer frequent one with at least subsumed_percent of their count are left out: the longer one's own parts are as frequent
    as it is, so it is enough to look at those one word longer. Order: score, a, both descending, then phrase by its bytes.
    A null lang is `und`; null and empty texts have no words; repeated rows count each; other columns are ignored; an empty table gives
    an empty one.
    """
    totals, levels = phrases(docs, max_words, min_count, names_bytes)
    scored = []
    for k, own in enumerate(levels[1:], 2):
        if k < max_words:
            longer = levels[k].select(F.explode(F.array_distinct(F.array("left", "right"))).alias("id"), F.col("f").alias("g")).groupBy("id").agg(F.max("g").alias("g"))
            own = own.join(longer, "id", "left").filter(F.col("g").isNull() | (100 * F.col("g") < subsumed_percent * F.col("f")))
        scored.append(own.join(F.broadcast(totals), "lang").withColumn("cut", _cut(k)).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score"))
    every = stored(reduce(DataFrame.unionByName, scored))
    discard(*levels[1:])
    best = lambda *key: F.row_number().over(Window.partitionBy("lang", *key).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    # the best of each salted part first, so that the last window of a language has a bounded number of rows
    few = every.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", best("salt")).filter(F.col("rank") <= keep).drop("salt")
    return few.withColumn("rank", best().cast("long")).filter(F.col("rank") <= keep).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM lists GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS k) WHERE len(w) >= k)),
freq AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= {MIN_COUNT}),
longer AS (SELECT lang, part, max(f) AS g FROM (
  SELECT lang, f, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS part FROM freq WHERE k > 2) GROUP BY lang, part),
cuts AS (
  SELECT p.lang, p.phrase, p.f AS a, l.f AS l, r.f AS r, t.n, (1000 * p.f * t.n) // (l.f * r.f) AS score, c
  FROM (SELECT *, unnest(range(1, k)) AS c FROM freq WHERE k > 1) p
  JOIN freq l ON l.lang = p.lang AND l.phrase = array_to_string(p.w[1:p.c], ' ')
  JOIN freq r ON r.lang = p.lang AND r.phrase = array_to_string(p.w[p.c + 1:p.k], ' ')
  JOIN total t ON t.lang = p.lang
  LEFT JOIN longer g ON g.lang = p.lang AND g.part = p.phrase
  WHERE g.g IS NULL OR 100 * g.g < {SUBSUMED_PERCENT} * p.f),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= {KEEP}
"""


def op12_rows(docs: DataFrame) -> DataFrame:
    return collocations(docs.select("text", "lang"))
