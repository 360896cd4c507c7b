"""Language identification by compression: the language whose dictionary compresses a text best.

The whole text is compressed as it is, in chunks, once under each language's raw-content dictionary. A dictionary saves an
almost fixed number of bytes, so the sizes of a text are sums over its chunks and their relative margin does not shrink with
length. A dictionary holds slices of sampled texts as they are written and, in a quarter of its bytes, in upper case.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.llm.common import rows_of

SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES, MIN_MARGIN = 256, 8000, 96 << 10, 0.004
SLICE_CHARS = 500
CHUNK_CHARS = 4096
LETTER = regex.compile(r"\p{L}")


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def settings() -> zstandard.ZstdCompressionParameters:
    """An optimal parser that matches three bytes or more: syllables count, not only whole words."""
    return zstandard.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=17, search_log=3, min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_dict_id=False)


def _filled(texts: list[str], room: int) -> bytes:
    """A slice of each text, then the next slice of each, up to room bytes: many texts count before much of one does."""
    out, held = [], 0
    for at in range(0, max(map(len, texts)), SLICE_CHARS):
        for text in texts:
            if held >= room:
                return b"\n".join(out)[:room]
            if part := _bytes(text[at : at + SLICE_CHARS]):
                out.append(part)
                held += len(part) + 1
    return b"\n".join(out)[:room]


def learn_dictionaries(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary per language, from (doc_id, text, lang) rows.

    The sample is bounded: about sample_docs rows of each language, chosen by a hash of doc_id, and of each text its
    first sample_chars characters, of which dictionary_bytes are kept: three quarters as written, the rest in upper case.
    Null texts and languages are left out, and of rows of one doc_id one is used. The languages come most frequent first, which settles ties.
    """
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL").filter("text <> ''")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    key = F.xxhash64("doc_id")
    some = rows.join(F.broadcast(sizes), "lang").filter(F.pmod(key, F.greatest(F.lit(1), F.floor(F.col("n") / sample_docs))) == 0)
    texts: dict[str, list[tuple[int, str]]] = {}
    rank = {}
    for r in some.select("lang", key.alias("key"), F.substring("text", 1, sample_chars).alias("text"), "n").dropDuplicates(["lang", "key"]).collect():
        texts.setdefault(r["lang"], []).append((r["key"], r["text"]))
        rank[r["lang"]] = (-r["n"], r["lang"])
    capitals = dictionary_bytes // 4
    out = {}
    for lang, found in sorted(texts.items(), key=lambda x: rank[x[0]]):
        parts = [text for _, text in sorted(found)]
        out[lang] = _filled([t.upper() for t in parts], capitals) + b"\n" + _filled(parts, dictionary_bytes - capitals - 1)
    return out


class Classifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs, self.by = list(dictionaries), []
        for data in dictionaries.values():
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=settings())
            self.by.append(zstandard.ZstdCompressor(dict_data=own, compression_params=settings()))

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): und for no letter or no language; margin is the share that the next best size is larger by."""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, 0.0
        chunks = [_bytes(text[at : at + CHUNK_CHARS]) for at in range(0, len(text), CHUNK_CHARS)]
        sizes = [sum(len(c.compress(data)) for data in chunks) for c in self.by]
        best, *others = sorted(sizes)
        scale = max(2.0, 0.02 * best)
        score = 1 / sum(math.exp((best - s) / scale) for s in sizes)
        return self.langs[sizes.index(best)], score, (others[0] - best) / others[0] if others else 1.0


def _judged(batches: Iterable[pa.RecordBatch], dictionaries) -> Iterator[pa.RecordBatch]:
    own = Classifier(dictionaries.value)
    for rows in rows_of(batches):
        found = [own.judge(t) for t in rows["text"]]
        yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), *(pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.float64(), pa.float64())))], ["doc_id", "lang_pred", "score", "margin"])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """Rows (doc_id, lang_pred, score, margin, rejected) for every document row, from whole texts.

    lang_pred is the language of the smallest compressed size (of equals the most frequent), und for a null text or one
    without letters. rejected: und, or a margin under min_margin. The dictionaries are bounded and broadcast.
    An empty table gives an empty one; without dictionaries every text is und.
    """
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _judged(it, sent), "doc_id long, lang_pred string, score double, margin double")
    return rows.withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("margin") < min_margin))


def _accepted(batches: Iterable[pa.RecordBatch], dictionaries, min_margin: float) -> Iterator[pa.RecordBatch]:
    own = Classifier(dictionaries.value)
    for batch in batches:
        judged = [own.judge(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        yield batch.filter(pa.array([lang != "und" and margin >= min_margin for lang, _, margin in judged], pa.bool_()))


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of docs, with all columns, whose language is not rejected (see identify)."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    return docs.mapInArrow(lambda it: _accepted(it, sent, min_margin), docs.schema)


def held_out(doc_id="doc_id"):
    return (F.crc32(F.col(doc_id).cast("string")) % 3 == 1) & F.col(doc_id).isNotNull()


def op9_rows(docs: DataFrame) -> DataFrame:
    found = identify(docs, learn_dictionaries(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")
