"""Delimited files, lookups and keyed updates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Delimiters that are tried, and forms of dates.
DELIMITERS = (",", ";", "\t", "|")
DATE = r"^\s*(\d{2}(\d{2})?[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2}(\d{2})?|\d{8})"


def sniff_delimiter(lines: Sequence[str]) -> str:
    """SC-3: the delimiter that splits most lines into the same number of cells, more than one; else the most frequent; else a comma."""
    best = []
    for d in DELIMITERS:
        cells, n = Counter(line.count(d) for line in lines if line).most_common(1)[0] if any(lines) else (0, 0)
        best.append((n if cells else 0, cells, d))
    n, _, found = max(best, key=lambda b: (b[0], b[1]))
    if n:
        return found
    counts = Counter({d: sum(line.count(d) for line in lines) for d in DELIMITERS})
    return counts.most_common(1)[0][0] if any(counts.values()) else ","


def read_table(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "UTF-8", sample: int = 50) -> DataFrame:
    """SC-1: a delimited file with a header, all columns strings; the delimiter is found from the first lines."""
    if delimiter is None:
        delimiter = sniff_delimiter([r[0] for r in spark.read.option("encoding", encoding).text(path).take(sample)])
    return spark.read.csv(path, sep=delimiter, header=True, encoding=encoding, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_ragged(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """SC-2: lines of any width as (line_no, cells); the names are the first line of the most cells, none of them empty.

    Columns are named by that line, which stays among the rows; shorter lines end in nulls.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")
    delimiter = delimiter or sniff_delimiter([r["value"] for r in lines.take(50)])
    cells = lines.select("line_no", F.split("value", f"[{delimiter}]").alias("cells"))
    width = cells.agg(F.max(F.size("cells")).alias("w")).first()["w"] or 0
    head = cells.filter((F.size("cells") == width) & ~F.exists("cells", lambda c: F.btrim(c) == "")).orderBy("line_no").select("cells").first()
    names = [c.strip() for c in head["cells"]] if head else [f"c{i}" for i in range(width)]
    return cells.select("line_no", *[F.nullif(F.btrim(F.get("cells", F.lit(i))), F.lit("")).alias(n) for i, n in enumerate(names)])


def column_kinds(df: DataFrame, sample: int = 20) -> dict[str, str]:
    """SC-4, SC-5: datetime, numeric or string for each string column, from its first values."""
    head = df.limit(sample)
    tests = []
    for c in df.columns:
        x = F.col(f"`{c}`").cast("string")
        tests += [F.bool_or(x.rlike(DATE)).alias(f"d{c}"), F.every(x.isNull() | x.try_cast("double").isNotNull()).alias(f"n{c}")]
    found = head.agg(*tests).first()
    kind = lambda c: "numeric" if found[f"n{c}"] and not found[f"d{c}"] else "datetime" if found[f"d{c}"] else "string"
    return {c: kind(c) for c in df.columns}


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SK-5, VE-16: rows replace those of the same key, nulls being equal; others are added."""
    same = None
    for k in keys:
        test = table[k].eqNullSafe(rows[k])
        same = test if same is None else same & test
    return table.join(rows, same, "left_anti").unionByName(rows, allowMissingColumns=True)


def associate(table: DataFrame, association: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """PF-15: columns taken from the association where it has a value. Raises if a key stands there more than once."""
    counted = association.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    once = counted.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns], F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("more than one row for "), F.col(key).cast("string")))).otherwise(F.lit(True)).cast("boolean").alias("_one"))
    joined = table.join(once, table[key] == F.col("_key"), "left").filter("_one IS NULL OR _one")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) if c in table.columns else F.col(f"_{c}") for c in columns}).drop("_key", "_one", *[f"_{c}" for c in columns])


def differences(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """PF-6: rows of either table without an equal one in the other, by key and value; doubles within the tolerance are equal."""
    others = [c for c in a.columns if c not in keys]
    doubles = {n for n, t in a.dtypes if t in ("double", "float")}
    both = a.select(*keys, F.struct(*others).alias("a")).join(b.select(*keys, F.struct(*others).alias("b")), list(keys), "full")
    same = F.lit(True)
    for c in others:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        same = same & (x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)) if c in doubles else x.eqNullSafe(y))
    return both.filter(F.col("a").isNull() | F.col("b").isNull() | ~same)


def looked_up(table: DataFrame, keys: DataFrame, key: str, value: str, single: bool = True) -> DataFrame:
    """PF-5: (key, value) of the wanted keys. Raises if a key is not in the table or, with single, is there more than once."""
    counted = table.groupBy(key).agg(F.count("*").alias("_n"))
    wrong = F.col("_n").isNull() | (F.lit(single) & (F.col("_n") > 1))
    met = keys.select(key).distinct().join(counted, key, "left").withColumn("_ok", F.when(wrong, F.raise_error(F.concat(F.lit("not exactly one row for "), F.col(key).cast("string")))).otherwise(F.lit(True)).cast("boolean"))
    return met.filter("_ok").join(table.select(key, value), key).select(key, value)


def column_containment(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PF-7: for each row of a, keyed by the first column, whether b has the key, and the same value in each other column."""
    key, *others = columns
    there = b.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in others], F.lit(True).alias("_found"))
    met = a.select(*columns).join(there, a[key].eqNullSafe(F.col("_key")), "left")
    found = F.coalesce("_found", F.lit(False))
    return met.select(key, found.alias("found"), *[(found & F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"same_{c}") for c in others])


def selected(text: str, names: Sequence[str]) -> list[str]:
    """Names chosen by numbers from 1, ranges and names, as in "1,3:5;name"; each once, in the order given."""
    out: dict[str, None] = {}
    for part in text.replace(";", ",").split(","):
        part = part.strip()
        first, colon, last = part.partition(":")
        if part.isdigit():
            out[names[int(part) - 1]] = None
        elif colon and first.strip().isdigit() and last.strip().isdigit():
            out |= dict.fromkeys(names[int(first) - 1 : int(last)])
        elif part in names:
            out[part] = None
        elif part:
            raise ValueError(f"{part} is not among the names")
    return list(out)
