"""Removal of repeated passages by matching statistics on suffix automata of reference shards.

Any two equal windows of words hold the same minimizer (the smallest hash among their short word runs), so only
windows whose minimizer occurs twice can repeat. A reference shard is all places of one such minimizer: each place is a
segment of words that covers the windows it stands for. Within a shard segments are streamed in document order through
the suffix automaton of those before; where the longest match reaches the window length, an equal window starts
earlier. A broadcast of the automata would be as large as the corpus, so shards and documents meet by a shuffle on the
minimizer instead. Shards with too many places are cut by document, and the windows that are new in their part meet
once more in shards by window hash; nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.llm.common import rows_of, stored

WINDOW, GRAM = 20, 6
SHARD_PLACES = 4096
RUN_BITS = 12  #: a run of windows is one number: the first one's place, then in so many bits how many they are
BATCH_WORDS = 1 << 19
OUT = "doc_id long, row long, start int, n int, words binary"
LAST = (1 << 63) - 1


class _Hashes(dict):
    """64-bit hashes of words, kept while they fit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _minimizers(hashes: np.ndarray, starts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows at starts: the place of the smallest run hash, the first of equals, and that hash."""
    n = len(hashes) - gram + 1
    runs = np.zeros(n, np.uint64)
    for k in range(gram):
        runs = (runs ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    reach = window - gram + 1
    least = np.lib.stride_tricks.sliding_window_view(runs, reach)[starts].argmin(1) + starts
    return least, runs[least]


def _places(batches: Iterable[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    known = _Hashes()

    def sent(ids, hashed, words):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        hashes = np.fromiter((known[w] for own in words for w in own), np.uint64, int(ends[-1]))
        counts = sizes - window + 1
        owner = np.repeat(np.arange(len(ids)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        least, value = _minimizers(hashes, (ends - sizes)[owner] + within, window, gram)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        n = np.diff(np.r_[first, len(least)])
        return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[owner[first]]), pa.array(np.array(hashed, np.int64)[owner[first]]), pa.array(within[first] << RUN_BITS | n), pa.array(value[first].view(np.int64))], ["doc_id", "row", "run", "minimizer"])

    for rows in rows_of(batches):
        ids, hashed, words, held = [], [], [], 0
        for doc_id, row, text in zip(rows["doc_id"], rows["row"], rows["text"]):
            own = split_words(text)
            if len(own) >= window:
                ids.append(doc_id)
                hashed.append(row)
                words.append(own)
                held += len(own)
            if held >= BATCH_WORDS:
                yield sent(ids, hashed, words)
                ids, hashed, words, held = [], [], [], 0
        if ids:
            yield sent(ids, hashed, words)


def _segments(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], [], [], [], []]
        for doc_id, row, text, places in zip(*(batch.column(i) for i in range(4))):
            words, doc_id, row = split_words(text.as_py()), doc_id.as_py(), row.as_py()
            salt = xxhash.xxh64_intdigest(str(doc_id), 11)
            for run, minimizer, parts in zip(*(places.values.field(k).to_pylist() for k in range(3))):
                start, n = run >> RUN_BITS, run & ((1 << RUN_BITS) - 1)
                part = 1 + salt % parts if parts > 1 else 0
                for column, value in zip(out, (minimizer, part, doc_id, row, run, b" ".join(words[start : start + n + window - 1]))):
                    column.append(value)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["shard", "part", "doc_id", "row", "run", "words"])


class SuffixAutomaton:
    """Of word sequences, which a unique mark keeps apart."""

    def __init__(self):
        self.next, self.link, self.length, self.last, self.marks = [{}], [-1], [0], 0, 0

    def _extend(self, word) -> None:
        nxt, link, length = self.next, self.link, self.length
        at = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[self.last] + 1)
        p, self.last = self.last, at
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = at
            p = link[p]
        if p == -1:
            return
        q = nxt[p][word]
        if length[p] + 1 == length[q]:
            link[at] = q
            return
        twin = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = twin
            p = link[p]
        link[q] = link[at] = twin

    def add(self, words: list) -> None:
        for word in words:
            self._extend(word)
        self.marks += 1
        self._extend(self.marks)

    def matches(self, words: list) -> list[int]:
        """The length of the longest run ending at each word that occurs in the automaton's sequences."""
        nxt, link, length = self.next, self.link, self.length
        state, found, out = 0, 0, []
        for word in words:
            while state and word not in nxt[state]:
                state = link[state]
                found = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                found += 1
            else:
                state, found = 0, 0
            out.append(found)
        return out


class _Shard:
    """The segments of a shard so far: contents seen, and the automaton of all but those that wait."""

    def __init__(self, window: int):
        self.window, self.seen, self.waiting, self.automaton = window, set(), [], None

    def repeated(self, words: bytes, n: int) -> list[bool]:
        """Which of the n windows of the next segment occur in the segments before."""
        if words in self.seen:
            return [True] * n
        own = words.split(b" ")
        if self.seen:
            self.automaton = self.automaton or SuffixAutomaton()
            for other in self.waiting:
                self.automaton.add(other)
            self.waiting = []
            found = [m >= self.window for m in self.automaton.matches(own)[self.window - 1 :]]
        else:
            found = [False] * n
        self.seen.add(words)
        self.waiting.append(own)
        return found


def _judge(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows as (doc_id, row, first word, words covered), and from shards that are cut (part over 0) the others with their words."""
    key, shard, last = None, None, None
    for batch in batches:
        out = [[], [], [], [], []]
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for own_shard, part, doc_id, row, run, words in zip(*columns):
            start, n = run >> RUN_BITS, run & ((1 << RUN_BITS) - 1)
            if (own_shard, part) != key:
                key, shard, last = (own_shard, part), _Shard(window), None
            if (doc_id, row, run) == last:  # of a repeated row
                continue
            last = doc_id, row, run
            flags, at = shard.repeated(words, n), 0
            while at < n:
                to = at
                while to < n and flags[to] == flags[at]:
                    to += 1
                if flags[at]:
                    for column, value in zip(out, (doc_id, row, start + at, to - at + window - 1, None)):
                        column.append(value)
                elif part:
                    own = words.split(b" ")
                    for k in range(at, to):
                        for column, value in zip(out, (doc_id, row, start + k, 1, b" ".join(own[k : k + window]))):
                            column.append(value)
                at = to
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["doc_id", "row", "start", "n", "words"])


def _judged(segments: DataFrame, window: int) -> DataFrame:
    ordered = segments.select("shard", "part", "doc_id", "row", "run", "words").repartition("shard", "part").sortWithinPartitions("shard", "part", "doc_id", "row", "run")
    return ordered.mapInArrow(lambda it: _judge(it, window), OUT)


def _told() -> list:
    """The number and the hash of the text that tell a row."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("row")]


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_places: int = SHARD_PLACES) -> DataFrame:
    """Spans (doc_id, row, start, n) of words in windows whose words also start earlier: in a smaller doc_id, or in the same document before.

    A document is a row: those of one doc_id with different texts are told apart and ordered by a hash of the text (row). A null doc_id
    is given as the largest long and comes behind all others.
    """
    docs = docs.filter("text IS NOT NULL").select(*_told(), "text")
    if not gram <= window < 1 << RUN_BITS:
        raise ValueError(f"gram must not exceed window, and window must be under {1 << RUN_BITS}")
    places = stored(docs.mapInArrow(lambda it: _places(it, window, gram), "doc_id long, row long, run long, minimizer long"))
    # stored, so that the join reads two plain shuffles, of which AQE can split the hot parts
    shards = stored(places.groupBy("minimizer").agg(F.count("*").alias("places")).filter("places > 1").select("minimizer", F.ceil(F.col("places") / shard_places).cast("int").alias("parts")))
    # stored as well: its shuffles are gone before those of the texts begin
    by_doc = stored(places.join(shards, "minimizer").groupBy("doc_id", "row").agg(F.collect_set(F.struct("run", "minimizer", "parts")).alias("places")))
    segments = docs.join(by_doc, ["doc_id", "row"]).mapInArrow(lambda it: _segments(it, window), "shard long, part int, doc_id long, row long, run long, words binary")
    found = stored(_judged(segments, window))
    new = found.filter("words IS NOT NULL").select(F.xxhash64("words").alias("shard"), F.lit(0).alias("part"), "doc_id", "row", (F.shiftleft(F.col("start").cast("long"), RUN_BITS) + F.col("n")).alias("run"), "words")
    return found.filter("words IS NULL").union(_judged(new, window)).select("doc_id", "row", "start", "n")


def _cleaned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], [], []]
        for doc_id, text, spans in zip(*(batch.column(i) for i in range(3))):
            words = split_words(text.as_py())
            gone = np.zeros(len(words) + 1, np.int64)
            if spans.is_valid:
                start, n = (spans.values.field(k).to_numpy() for k in range(2))
                np.add.at(gone, np.minimum(start, len(words)), 1)
                np.add.at(gone, np.minimum(start + n, len(words)), -1)
            keep = np.cumsum(gone)[:-1] == 0
            kept = b" ".join(w for w, k in zip(words, keep.tolist()) if k)
            for column, value in zip(out, (doc_id.as_py(), kept, len(words), len(words) - int(keep.sum()))):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["doc_id", "kept", "n_words", "n_removed"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_places: int = SHARD_PLACES) -> DataFrame:
    """One row per document row: doc_id, text (the words that stay, in single spaces), n_words, n_removed.

    A word is removed if a window of that many words covers it whose words also start earlier; windows are judged on
    the input. Null texts have no words; rows without a doc_id come behind all others; rows of equal doc_id and text are one document,
    those of one doc_id with different texts documents of their own (see repeated_spans). Other columns are ignored and an empty table
    gives an empty one.
    """
    spans = repeated_spans(docs, window, gram, shard_places).groupBy(F.col("doc_id").alias("span_id"), F.col("row").alias("span_row")).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    number, row = _told()
    own = docs.select(F.col("doc_id").cast("long"), number.alias("own_id"), row.alias("own_row"), "text")
    joined = own.join(spans, (F.col("own_id") == F.col("span_id")) & (F.col("own_row") == F.col("span_row")), "left").select("doc_id", "text", "spans")
    out = joined.mapInArrow(_cleaned, "doc_id long, kept binary, n_words long, n_removed long")
    return out.select("doc_id", F.decode("kept", "UTF-8").alias("text"), "n_words", "n_removed")


def op8_rows(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + {WINDOW} - 1], ' ')) AS run
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW} + 2)) AS i) WHERE len(w) >= {WINDOW}),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS r FROM places) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM later) GROUP BY doc_id),
kept AS (SELECT d.doc_id, w, CASE WHEN ks IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ks, i)), lambda i: w[i]) END AS k FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
