"""Near-duplicate documents by SimHash with a Gray-ordered hierarchical index.

Fingerprints are made in Arrow batches (one pass over the text); the distinct ones are linked by the index (see hamming)
and their components are named by the smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.llm.common import hex64, rows_of, stored
from scarpline.llm.components import connected_components
from scarpline.llm.hamming import MAX_BITS, hamming_links
from scarpline.llm.similar import similar

SEED = 42
CHUNK = 1 << 15


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned SimHash of the lower-cased (A-Z) word shingles of a text; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends[width - 1 :].tolist()
    ones, n = np.zeros(64, np.int64), len(ends)
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[p:q], SEED) for p, q in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(np.uint64)[0])


def _fingerprints(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for rows in rows_of(batches):
        fps = np.array([fingerprint(t, width) for t in rows["text"]], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(fps)], ["doc_id", "fp"])


def near_duplicates(docs: DataFrame, width: int = 4, bound: int = MAX_BITS) -> DataFrame:
    """One row per document row: doc_id, fp (long), component_id (the smallest doc_id that links reach).

    Null texts and texts without words have fingerprint 0 and link like others; a null doc_id is never the smallest
    unless its component has no other. Repeated rows give repeated rows. Other columns are ignored, an empty table
    gives an empty one. Documents of equal fingerprint meet only in pre-aggregated minima.
    """
    fps = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _fingerprints(it, width), "doc_id long, fp long"))
    first = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(hamming_links(first, bound))
    with_root = first.join(roots, first.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # a table of its own, so that AQE can split the join at a component of very many fingerprints
    least = stored(with_root.groupBy("root").agg(F.min("first").alias("component_id")))
    names = with_root.join(least, "root").select("fp", "component_id")
    return fps.join(names, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that stand for their group of similar texts (see similar): one row of each group.

    It is that of the smallest doc_id, of equals that of the smallest hash of doc_id and text; a row without a doc_id stands
    for its group if no row has one. Of rows of equal doc_id and text one stays.
    """
    keys = [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), "doc_id", "text").alias("k2")]
    nodes, roots = similar(docs.select(*keys, "text"), fingerprints=True)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("m")
    ids = docs.select(*keys, "doc_id").distinct()
    firsts = ids.join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(first)
    chosen = firsts.select(F.col("m.k1").alias("_k1"), F.col("m.k2").alias("_k2"))
    own = docs.withColumns({"_key1": keys[0], "_key2": keys[1]})
    return own.join(chosen, (F.col("_key1") == F.col("_k1")) & (F.col("_key2") == F.col("_k2")), "left_semi").dropDuplicates(["_key1", "_key2"]).drop("_key1", "_key2")


def op3_rows(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
