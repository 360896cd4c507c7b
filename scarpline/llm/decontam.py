"""Benchmark decontamination by a prefix-filtered set join, by DataFrame functions only.

A window is a run of item words; its shingles are its runs of three words (fewer in shorter items). One pass over the
documents finds the places of the items' shingles. Their counts give the order by rarity; an exact match needs all
shingles of a window, so the rarest alone is the necessary prefix. Each place of a prefix shingle is a candidate start,
kept if the whole window fits in the document, and verified by the window's other shingles at their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarpline.llm.common import bounded_broadcast, stored

WINDOW, SHINGLE = 10, 3
WORD = "[0-9a-z\\x80-\\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased: runs of digits, letters a-z and characters beyond ASCII."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _neighbours(column: str, size: int) -> Column:
    """Each word with the next ones, as an array of structs w0, w1 and so on; null beyond the end."""
    return F.arrays_zip(*[F.slice(column, k + 1, F.greatest(F.size(column) - k, F.lit(0))).alias(f"w{k}") for k in range(size)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (item_id, run array, n): the distinct windows of each item; an item of fewer words, but some, is one window."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    runs = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("run")).distinct()
    return runs.select("item_id", "run", F.size("run").alias("n"))


def _parts(run: Column, n: Column) -> Column:
    """The shingles of a window, in order; their places count from 0."""
    size = F.least(F.lit(SHINGLE), n)
    return F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(run, i, size), " "))


def _search(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, doc_id, n_words) of every row of docs, the matches (row, start, n, wid), and the items' windows (wid, item_id).

    docs are read once and each row has a number of its own, whatever its doc_id.
    """
    runs = stored(benchmark_windows(benchmark, window))
    windows = stored(runs.select("run", "n").distinct().withColumn("wid", F.monotonically_increasing_id()))
    parts = stored(windows.select("wid", "n", F.posexplode(_parts(F.col("run"), F.col("n"))).alias("off", "shingle")))
    sizes = [r[0] for r in parts.select(F.least(F.lit(SHINGLE), F.col("n"))).distinct().collect()] or [SHINGLE]
    held = parts.agg(F.sum(F.octet_length("shingle") + 64)).first()[0] or 0
    known = parts.select("shingle").distinct()
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    places = own.select("row", "doc_id", F.greatest(F.size("w"), F.lit(0)).alias("n_words"), F.posexplode_outer(_neighbours("w", max(sizes))).alias("place", "s"))
    names = [f"s.w{k}" for k in range(max(sizes))]
    texts = [F.when(F.col(names[k - 1]).isNotNull(), F.concat_ws(" ", *names[:k])) for k in sizes]
    rows = places.select("row", "doc_id", "n_words", "place", F.posexplode(F.array(*texts)).alias("which", "text"))
    own_row = (F.col("which") == 0) & F.coalesce(F.col("place") == 0, F.lit(True))  # one of each document's rows carries its size
    joined = rows.join(bounded_broadcast(known, held), F.col("text") == F.col("shingle"), "left").withColumn("own", own_row).filter("own OR shingle IS NOT NULL")
    found = stored(joined.select("row", F.when(F.col("own"), F.col("doc_id")).alias("doc_id"), "n_words", "place", "shingle", "own"))
    occurring = found.filter("shingle IS NOT NULL").select("row", "n_words", "place", "shingle")
    counts = occurring.groupBy("shingle").agg(F.count("*").alias("count"))
    rare = Window.partitionBy("wid").orderBy("count", "off")  # a window has as many shingles as words at most
    prefix = parts.join(counts, "shingle", "left").withColumn("count", F.coalesce("count", F.lit(0))).withColumn("r", F.row_number().over(rare)).filter("r = 1 AND count > 0").select("wid", "n", "off", "shingle")
    candidates = occurring.join(bounded_broadcast(prefix, held), "shingle").select("row", (F.col("place") - F.col("off")).alias("start"), "n_words", "wid", "n").filter("start >= 0 AND start + n <= n_words").distinct()
    # the window's shingles, each of which has to be at its place
    checks = candidates.select("row", "start", "n", "wid").join(bounded_broadcast(parts.select("wid", "off", "shingle"), held), "wid").withColumn("place", F.col("start") + F.col("off"))
    there = checks.join(occurring.select("row", "place", "shingle").distinct(), ["row", "place", "shingle"])
    need = F.col("n") - F.least(F.lit(SHINGLE), F.col("n")) + 1
    exact = there.groupBy("row", "start", "n", "wid").agg(F.count("*").alias("found")).filter(F.col("found") == need)
    return found.filter("own").select("row", "doc_id", "n_words"), stored(exact.select("row", "start", "n", "wid")), stored(runs.join(windows, ["run", "n"]).select("wid", "item_id"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, start, n, item_id): each window of an item and each place of a document where it occurs, words counted from 0."""
    own, found, items = _search(docs, benchmark, window)
    return found.join(own.select("row", "doc_id"), "row").join(items, "wid").select("doc_id", "start", "n", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit (words in occurrences of item windows), n_items, items, contaminated.

    A null text has no words. An empty benchmark hits nothing, an empty table of documents gives an empty one. Each row
    is judged by its own text, also if its doc_id is null or on other rows too. Repeated rows of an item are one item, an
    item with a null item_id hits but is not listed. Other columns are ignored.
    """
    own, found, of_item = _search(docs, benchmark, window)
    # windows are made distinct by row before they meet their items
    items = found.select("row", "wid").distinct().join(of_item, "wid").select("row", F.col("item_id").cast("string").alias("item")).filter("item IS NOT NULL").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    spans = found.groupBy("row", "start").agg(F.max(F.col("start") + F.col("n")).alias("stop"))
    order = Window.partitionBy("row").orderBy("start")
    reached = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = spans.withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", reached))).groupBy("row").agg(F.sum("new").alias("n_hit"))
    out = own.join(hits, "row", "left").join(items, "row", "left")
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all columns, whose text holds no window of an item.

    That is a matter of the text alone, so rows are told by two hashes of it: null and repeated doc_ids, repeated rows and
    columns of any name make no difference. A null or empty text stays.
    """
    hashes = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b"))
    own, found, _ = _search(docs.select(hashes.alias("doc_id"), "text"), benchmark, window)
    hit = found.select("row").distinct().join(own, "row").select(F.col("doc_id").alias("_hit")).distinct()
    return docs.withColumn("_of", hashes).join(hit, F.col("_of") == F.col("_hit"), "left_anti").drop("_of")


def op10_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP10_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
runs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + {WINDOW} - 1], ' ') AS run, least(len(w), {WINDOW}) AS n
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM runs),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS run
  FROM d, lengths, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
found AS (SELECT p.doc_id, p.i, p.n, r.item_id FROM places p JOIN runs r ON p.run = r.run AND p.n = r.n),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
