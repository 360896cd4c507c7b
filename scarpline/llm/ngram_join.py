"""Documents joined by the Jaccard similarity of their five-word shingles.

The work is done by similar(): rare shingles of extended prefixes are indexed one by one, frequent ones by combinations of two or three,
and every candidate is verified. Here texts become classes and documents get the class they belong to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.llm.common import discard, stored
from scarpline.llm.similar import similar


def ngram_groups(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included).

    Texts are linked if their sets of lower-cased (A-Z) five-word shingles have a Jaccard similarity of at least 0.8; a text of one to four
    words is one shingle. Null texts and texts without words have an empty set and are linked with nothing, so their class is their own
    doc_id. Equal texts are linked. A null doc_id is linked like others and never the smallest, unless its class has no other: then the class
    is null. Repeated rows give repeated rows. Other columns are ignored, an empty table gives an empty one.
    """
    keys = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2")]
    sets, roots = similar(docs.select(*keys, "text"))
    named = sets.join(roots, "node", "left").select("t1", "t2", "n", F.coalesce("root", "node").alias("root"))
    rows = stored(docs.select(F.col("doc_id").cast("long"), *keys).join(named, ["t1", "t2"]).select("doc_id", F.col("n").alias("n_shingles"), "root"))
    discard(sets, roots)
    least = stored(rows.groupBy("root").agg(F.min("doc_id").alias("least")))
    return rows.join(least, "root").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


OP11_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, ways.y FROM reach JOIN ways ON reach.other = ways.x)
SELECT d.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""


def op11_rows(docs: DataFrame) -> DataFrame:
    return ngram_groups(docs.select("doc_id", "text"))
