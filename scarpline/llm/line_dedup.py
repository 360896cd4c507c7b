"""Removal of repeated and nearly repeated lines, by DataFrame functions only.

Two lines that differ by one edit agree on their first or on their second half, so only lines that share a half with
another distinct line can have a near copy. These lines emit their deletion neighbourhood: every variant with one
character deleted as (place, hash), and themselves as a hash. Lines that delete the same place to the same variant are
one substitution apart; a line equal to a variant is one insertion apart. Equal keys are joined to the earliest line
of each, so no pairs within a group are made, and edit distance is verified on the texts.

A variant's hash is made of three: of the text up to the block of the deleted character, of the block without it, and of
the text behind it. Blocks grow with the root of the line's length, so the work for a line of n characters is n ** 1.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarpline.llm.common import bounded_broadcast, stored

MIN_CHARS = 16
MIN_BLOCK = 128
LAST = (1 << 63) - 1


def _hash2(prefix: str, text: Column) -> list[Column]:
    """Two independent 64-bit hashes, which together name a text."""
    return [F.xxhash64(text).alias(f"{prefix}1"), F.xxhash64(F.lit(7), text).alias(f"{prefix}2")]


def _half_keys(text: Column) -> Column:
    """(side, hash) of the first and last h characters, h half of this line's length or of a line's that is one shorter."""
    n = F.char_length(text)
    halves = [(n / 2).cast("int"), ((n - 1) / 2).cast("int")]
    keys = [F.struct(F.lit(side).alias("side"), F.xxhash64(F.lit(side), h, part).alias("key")) for h in halves for side, part in ((0, F.substr(text, F.lit(1), h)), (1, F.right(text, h)))]
    return F.array_distinct(F.array(*keys))


def _marks(numbers: Column) -> Column:
    """Sorted line numbers as an array that is true at them and false at the lines before."""
    before = F.concat(F.array(F.lit(-1)), numbers)
    part = lambda a, b: F.when(b.isNull(), F.array().cast("array<boolean>")).otherwise(F.concat(F.array_repeat(F.lit(False), b - a - 1), F.array(F.lit(True))))
    return F.flatten(F.zip_with(before, numbers, part))


def _block(n: Column) -> Column:
    """The block size for lines of n characters: a power of two near its root."""
    return F.greatest(F.lit(MIN_BLOCK), F.pow(F.lit(2), F.round(F.log2(n.cast("double")) / 2)).cast("int"))


def _around(line: Column, size: Column, block: Column, skip: Column) -> tuple[Column, Column]:
    """Hashes of the text before a block and of the text behind it; the block has `skip` characters fewer than size."""
    return F.xxhash64(F.substr(line, F.lit(1), block * size)), F.xxhash64(F.substr(line, (block + 1) * size - skip + 1))


def _bound(names: dict[str, Column], of) -> Column:
    """The value of a function of a struct of columns, each of which is worked out once and not anew in every lambda."""
    return F.transform(F.array(F.struct(*[c.alias(k) for k, c in names.items()])), of)[0]


def _deletions(side: Column, line: Column) -> Column:
    """(place, hash) of the variants with one character deleted outside of the half that the line shares."""
    n = F.char_length(line)
    half = ((n - 1) / 2).cast("int")
    low, high = F.when(side == 0, half + 1).otherwise(F.lit(1)), F.when(side == 0, n).otherwise(n - half)

    def of_line(v):
        def of_block(block):
            before, behind = _around(line, v.size, block, F.lit(0))
            at = F.sequence(F.greatest(v.low - block * v.size, F.lit(1)), F.least(v.high - block * v.size, v.size))
            variants = lambda x: F.transform(at, lambda i: F.struct((x.start + i).alias("place"), F.xxhash64(block, x.a, F.concat(F.substr(x.own, F.lit(1), i - 1), F.substr(x.own, i + 1)), x.b).alias("key")))
            return _bound({"start": block * v.size, "a": before, "own": F.substr(line, block * v.size + 1, v.size), "b": behind}, variants)

        return F.flatten(F.transform(F.sequence(((v.low - 1) / v.size).cast("int"), ((v.high - 1) / v.size).cast("int")), of_block))

    return _bound({"size": _block(n), "low": low, "high": high}, of_line)


def _wholes(line: Column) -> Column:
    """The hashes that a line one character longer gives to the variants equal to this line, one for each block of a deletion."""
    n = F.char_length(line)

    def of_line(v):
        def of_block(block):
            before, behind = _around(line, v.size, block, F.lit(1))
            return F.xxhash64(block, before, F.substr(line, block * v.size + 1, v.size - 1), behind)

        return F.transform(F.sequence(F.lit(0), (v.n / v.size).cast("int")), of_block)

    return _bound({"size": _block(n + 1), "n": n}, of_line)


def _one_edit_at(a: Column, b: Column, place: Column) -> Column:
    """Whether a changed, missing or added character at a place makes one line of the other, in linear time."""
    without = lambda x: F.concat(F.substr(x, F.lit(1), place - 1), F.substr(x, place + 1))
    more = F.char_length(a) - F.char_length(b)
    return F.when(more == 0, without(a) == without(b)).when(more == 1, without(a) == b).when(more == -1, without(b) == a).otherwise(False)


def _rows(docs: DataFrame) -> list[Column]:
    """The document number and the hash of the text that tell a row: a null doc_id comes behind all others."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64("text")]


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.btrim("line", F.lit(" \t\r")))


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = 1, exact_chars: int | None = None) -> DataFrame:
    """Places (doc_id, row, line_no) of the lines that an equal or nearly equal line precedes.

    A line is its text between newlines, trimmed of spaces, tabs and carriage returns; lines of fewer than min_chars
    characters are left alone, but for equal ones of at least exact_chars (default min_chars). A line is repeated if a line at most max_edits (0 or 1) character edits away comes
    earlier, by doc_id and then line number. That is judged on the input, whatever is removed. Rows of one doc_id with different texts are
    documents of their own, told apart and ordered by a hash of the text (row); a null doc_id is given as the largest long.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    number, row = _rows(docs)
    docs = docs.filter("text IS NOT NULL").select(number.alias("doc_id"), row.alias("row"), "text")
    place = ["doc_id", "row", "line_no"]
    size = F.char_length("line")
    long = _lines(docs).filter(size >= (min_chars if exact_chars is None else min(exact_chars, min_chars)))
    at = F.struct(*place)
    hashed = long.select(*place, *_hash2("h", F.col("line")), *([F.when(size >= min_chars, _half_keys(F.col("line"))).alias("keys")] if max_edits else []))
    hashed = stored(hashed)
    # stored, so that the join below reads two plain shuffles, of which AQE can split the hot lines
    first = stored(hashed.groupBy("h1", "h2").agg(F.min(at).alias("m"), F.count("*").alias("n")).select("h1", "h2", F.col("m.doc_id").alias("d"), F.col("m.row").alias("r"), F.col("m.line_no").alias("l"), "n"))
    exact = hashed.select(*place, "h1", "h2").join(first.filter("n > 1").drop("n"), ["h1", "h2"]).filter("doc_id <> d OR row <> r OR line_no <> l").select(*place)
    if not max_edits:
        return exact.distinct()
    firsts = hashed.join(first.select("h1", "h2", F.col("d").alias("doc_id"), F.col("r").alias("row"), F.col("l").alias("line_no")), ["h1", "h2", *place], "left_semi")
    keyed = firsts.select(*place, F.explode("keys").alias("k")).select(*place, "k.side", "k.key")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    sides = keyed.join(shared, "key", "left_semi").groupBy(*place).agg(F.sort_array(F.collect_set("side")).alias("sides"))
    near = stored(sides.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("line_no", "sides"))).alias("near")))
    held = near.agg(F.sum(64 * F.size("near") + 64)).first()[0] or 0
    # the texts of these lines; each split is an argument of a function, so that it is made once a document
    picked = F.zip_with(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))), _marks(F.col("near.line_no")), lambda s, m: F.when(m, s))
    wanted = docs.join(bounded_broadcast(near, held), ["doc_id", "row"]).select("doc_id", "row", F.explode(F.zip_with(F.filter(picked, lambda s: s.isNotNull()), F.col("near.sides"), lambda s, k: F.struct(s.line_no.alias("line_no"), s.line.alias("line"), k.alias("sides")))).alias("x")).select("doc_id", "row", "x.*")
    wanted = stored(wanted.filter("line IS NOT NULL").withColumn("line", F.btrim("line", F.lit(" \t\r"))).distinct())
    by_side = wanted.select(at.alias("at"), "line", F.explode("sides").alias("side"))
    variants = by_side.select("at", F.explode(_deletions(F.col("side"), F.col("line"))).alias("v")).select("at", "v.place", "v.key")
    keys = variants.union(wanted.select(at.alias("at"), F.lit(0).alias("place"), F.explode(_wholes(F.col("line"))).alias("key")))
    # a key's lines are bounded by the characters that one place can hold, so windows serve; both need one shuffle
    alike = keys.withColumn("whole", F.min(F.when(F.col("place") == 0, F.col("at"))).over(Window.partitionBy("key"))).withColumn("first", F.min("at").over(Window.partitionBy("key", "place"))).filter("place > 0")
    # the earliest of those that delete the same place to the same variant; a line that is the variant itself
    pairs = alike.select("at", "place", F.explode(F.array("first", "whole")).alias("other")).filter("other IS NOT NULL AND other <> at")
    found = pairs.groupBy(F.greatest("at", "other").alias("at"), F.least("at", "other").alias("other_at")).agg(F.min("place").alias("place"))
    texts = wanted.select(at.alias("at"), "line")
    both = found.join(texts, "at").join(texts.select(F.col("at").alias("other_at"), F.col("line").alias("other")), "other_at")
    verified = both.filter(_one_edit_at(F.col("line"), F.col("other"), F.col("place")))
    return exact.union(verified.select("at.doc_id", "at.row", "at.line_no")).distinct()


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = 1, exact_chars: int | None = None) -> DataFrame:
    """The documents without their repeated lines (see repeated_lines), with n_lines and n_removed.

    All columns are kept and text is replaced. A null text has no lines and stays null; an empty text is one empty line, which stays.
    Rows without a doc_id come behind all others. Rows of equal doc_id and text count as one document, those of one doc_id with
    different texts as documents that a hash of the text puts in order. An empty table gives an empty one.
    """
    gone = repeated_lines(docs, min_chars, max_edits, exact_chars).groupBy(F.col("doc_id").alias("_gone_id"), F.col("row").alias("_gone_row")).agg(F.sort_array(F.collect_set("line_no")).alias("_gone"))
    number, row = _rows(docs)
    joined = docs.withColumns({"_number": number, "_row": row}).join(gone, (F.col("_number") == F.col("_gone_id")) & (F.col("_row") == F.col("_gone_row")), "left").withColumn("_n", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))))
    left = F.zip_with(F.split("text", "\n"), _marks(F.col("_gone")), lambda x, m: F.when(F.coalesce(m, F.lit(False)), None).otherwise(x))
    kept = F.when(F.col("_gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    n_removed = F.when(F.col("_gone").isNull() | F.col("text").isNull(), 0).otherwise(F.size(F.filter("_gone", lambda i: i < F.col("_n")))).cast("long")
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return joined.select(*others, kept.alias("text"), F.col("_n").cast("long").alias("n_lines"), n_removed.alias("n_removed"))


def op4_rows(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


OP4_SQL = f"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, trim(parts[i], ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
long_lines AS (SELECT *, length(line) AS n FROM lines WHERE length(line) >= {MIN_CHARS}),
firsts AS (SELECT line, n, min((doc_id, line_no)) AS at FROM long_lines GROUP BY line, n),
pairs AS (
  SELECT a.line AS x, b.line AS y, a.n AS nx, b.n AS ny, a.at AS ax, b.at AS ay FROM firsts a JOIN firsts b ON left(a.line, a.n // 2) = left(b.line, a.n // 2) AND b.n BETWEEN a.n AND a.n + 1 AND a.at <> b.at
  UNION
  SELECT a.line, b.line, a.n, b.n, a.at, b.at FROM firsts a JOIN firsts b ON right(a.line, a.n // 2) = right(b.line, a.n // 2) AND b.n BETWEEN a.n AND a.n + 1 AND a.at <> b.at
  UNION
  SELECT a.line, b.line, a.n, b.n, a.at, b.at FROM firsts a JOIN firsts b ON right(a.line, a.n // 2 - 1) = right(b.line, a.n // 2 - 1) AND b.n BETWEEN a.n AND a.n + 1 AND a.at <> b.at
  UNION
  SELECT a.line, b.line, a.n, b.n, a.at, b.at FROM firsts a JOIN firsts b ON left(a.line, a.n // 2 - 1) = left(b.line, a.n // 2 - 1) AND b.n BETWEEN a.n AND a.n + 1 AND a.at <> b.at),
near AS (
  SELECT ax, ay FROM pairs
  WHERE len(list_filter(range(1, ny + 1), lambda i: CASE WHEN nx = ny THEN substr(x, 1, i - 1) || substr(x, i + 1) = substr(y, 1, i - 1) || substr(y, i + 1) ELSE x = substr(y, 1, i - 1) || substr(y, i + 1) END)) > 0),
removed AS (
  SELECT l.doc_id, l.line_no FROM long_lines l JOIN firsts f USING (line) WHERE f.at <> (l.doc_id, l.line_no)
  UNION SELECT greatest(ax, ay)[1], greatest(ax, ay)[2] FROM near)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
  CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed,
  CASE WHEN g.gone IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(g.gone, i - 1)), chr(10)) END AS text
FROM documents d LEFT JOIN (SELECT doc_id, list(line_no) AS gone FROM removed GROUP BY doc_id) g USING (doc_id)
"""
