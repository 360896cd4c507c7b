"""Gauge tables and series: kinds of columns by their names and values, dates in any form, stacked files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scarpline.functions import scalars
from scarpline.operators import timeseries
from scarpline.sources.tables import DATE, sniff_delimiter

#: Per kind of column the marks in its name, its type and its range.
KINDS = {
    "station": (("stat", "staz", "gauge", "id", "poste"), "string", None),
    "numeric_station_id": (("stat", "staz", "gauge", "id", "poste"), "numeric", None),
    "latitude": (("lat", "latit", "breite"), "numeric", (-90, 90)),
    "longitude": (("lon", "long", "länge"), "numeric", (-180, 180)),
    "altitude": (("alt", "elev", "height", "quota", "höhe"), "numeric", (0, 3000)),
    "start_date": (("start", "inizio", "begin", "debut", "anfang", "inicio", "from", "dat"), "datetime", None),
    "end_date": (("end", "fin", "to", "dat"), "datetime", None),
    "cumulative_rain": (("cum", "cumul", "tot", "somma", "sum", "rain", "pioggia", "regen", "lluvia", "valor", "valeur", "precipitaz"), "numeric", (0, 1000)),
    "min_cumulative_rain": (("min", "mín", "niedrigst", "cum", "cumul", "somma", "sum", "rain", "pioggia", "regen", "lluvia"), "numeric", (0, 1000)),
    "max_cumulative_rain": (("max", "mín", "niedrigst", "mas", "máx", "höchst", "cum", "cumul", "somma", "sum", "rain", "pioggia", "regen", "lluvia"), "numeric", (0, 1000)),
    "peak_rain": (("pk", "peak", "max", "mas", "máx", "höchst", "picco", "rain", "pioggia", "regen", "lluvia"), "numeric", (0, 1000)),
    "average_temperature": (("avg", "aver", "med", "durchschnitt", "promedio", "temp"), "numeric", (-50, 50)),
    "maximum_temperature": (("max", "mas", "máx", "höchst", "temp"), "numeric", (-50, 50)),
    "minimum_temperature": (("min", "mín", "niedrigst", "temp"), "numeric", (-50, 50)),
}
#: Forms of dates that are tried in this order; those of days first come before those of months first.
FORMS = ("yyyy-M-d[ H:mm[:ss]]", "yyyy/M/d[ H:mm[:ss]]", "d/M/yyyy[ H:mm[:ss]]", "d-M-yyyy[ H:mm[:ss]]", "d.M.yyyy[ H:mm[:ss]]", "M/d/yyyy[ H:mm[:ss]]", "yyyyMMdd[ HHmm]", "yyyy-MM-dd'T'HH:mm:ss")


def parsed_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """SC-12: string columns as timestamps, each by the form that reads most of its values; of equals the earlier in FORMS."""
    if not columns:
        return df
    tried = lambda c, form: F.try_to_timestamp(F.btrim(F.col(f"`{c}`")), F.lit(form))
    counts = df.agg(*[F.count(tried(c, form)).alias(f"{i}_{k}") for i, c in enumerate(columns) for k, form in enumerate(FORMS)]).first()
    best = {c: max(range(len(FORMS)), key=lambda k: (counts[f"{i}_{k}"], -k)) for i, c in enumerate(columns)}
    return df.withColumns({c: tried(c, FORMS[k]) for c, k in best.items()})


def kind_scores(df: DataFrame, head: int = 50) -> dict[str, dict[str, float]]:
    """PF-10: for each column the score of each kind, from its name, the type of its first values and its whole range.

    0.3 for a mark in the name and 0.15 for each more, 0.3 for or against the type of most of the first values (0.1 for
    strings where dates are due), 0.3 for numbers in the kind's range. One row per table comes to the driver.
    """
    quoted = lambda c: F.col(f"`{c}`").cast("string")
    first = df.limit(head).agg(*[F.count_if(quoted(c).rlike(DATE)).alias(f"d{c}") for c in df.columns], *[F.count_if(~F.coalesce(quoted(c).rlike(DATE), F.lit(False)) & quoted(c).try_cast("double").isNotNull()).alias(f"n{c}") for c in df.columns], *[F.count(quoted(c)).alias(f"a{c}") for c in df.columns]).first()
    whole = df.agg(*[F.min(quoted(c).try_cast("double")).alias(f"a{c}") for c in df.columns], *[F.max(quoted(c).try_cast("double")).alias(f"b{c}") for c in df.columns]).first()
    out = {}
    for c in df.columns:
        counts = {"datetime": first[f"d{c}"], "numeric": first[f"n{c}"], "string": first[f"a{c}"] - first[f"d{c}"] - first[f"n{c}"]}
        most, low, high = max(counts, key=counts.get), whole[f"a{c}"], whole[f"b{c}"]
        out[c] = {}
        for kind, (marks, due, span) in KINDS.items():
            hits = sum(m in c.lower() for m in marks)
            score = 0.3 + 0.15 * (hits - 1) if hits else 0.0
            score += 0.3 if most == due else 0.1 if (due, most) == ("datetime", "string") else -0.3
            if due == most == "numeric" and span and low is not None and span[0] <= low and high <= span[1]:
                score += 0.3
            out[c][kind] = score
    return out


def detect_columns(df: DataFrame, targets: Sequence[str], least: float = 0.5) -> dict[str, str]:
    """PF-11: the column of each wanted kind: each column stands for its best kind if that scores over `least`; of those of one kind the best."""
    scores, out = kind_scores(df), {}
    for c, own in scores.items():
        kind = max(own, key=own.get)
        if own[kind] > least and (kind not in out or own[kind] > scores[out[kind]][kind]):
            out[kind] = c
    for kind in targets:  # a kind that is nobody's best takes the free column that suits it most
        free = [c for c in df.columns if c not in out.values()]
        if kind not in out and free and max(scores[c][kind] for c in free) > least:
            out[kind] = max(free, key=lambda c: scores[c][kind])
    return {kind: out[kind] for kind in targets if kind in out}


def ordered_columns(df: DataFrame, low: str, high: str, share: float = 0.7) -> DataFrame:
    """PF-12: low and high exchanged if fewer than `share` of the rows that have both have the larger value in high."""
    met = df.agg(F.avg((F.col(high) > F.col(low)).cast("int")).alias("s")).first()["s"]
    if met is None or met >= share:
        return df
    return df.withColumns({low: F.col(high), high: F.col(low)})


def read_stations(table: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """SC-13: (station, longitude, latitude, altitude) from named or detected columns, which must be four different ones."""
    wanted = ("station", "longitude", "latitude", "altitude")
    found = {**detect_columns(table, wanted), **(columns or {})}
    if len({found.get(k) for k in wanted} - {None}) < 4:
        raise ValueError(f"no four columns for {', '.join(wanted)}: {found}")
    number = lambda k: F.col(f"`{found[k]}`").try_cast("double").alias(k)
    return table.select(F.btrim(F.col(f"`{found['station']}`").cast("string")).alias("station"), *map(number, wanted[1:]))


def read_series(table: DataFrame, metric: str, date: str | None = None, value: str | None = None, no_data: Sequence = (), low: float | None = None, high: float | None = None, fill: str = "zero", station: Column | None = None) -> DataFrame:
    """SC-12, TS-1: (station, ts, value) from a raw table: dates read and rounded to minutes, no-data and values out of range as gaps, gaps filled.

    Rows without a date go; of repeated times the largest value counts.
    """
    date = date or detect_columns(table, ("start_date", "end_date")).get("start_date") or detect_columns(table, ("end_date",)).get("end_date")
    value = value or detect_columns(table, (metric,)).get(metric)
    if date is None or value is None:
        raise ValueError("no column of dates or of values was found")
    own = parsed_dates(table.select((station if station is not None else F.lit(0)).alias("station"), F.col(f"`{date}`").alias("ts"), F.col(f"`{value}`").try_cast("double").alias("value")), ["ts"])
    kept = scalars.filter_numeric(scalars.drop_no_data(F.col("value"), no_data), low, high)
    own = own.filter("ts IS NOT NULL").select("station", scalars.round_minute(F.col("ts")).alias("ts"), kept.alias("value"))
    return timeseries.fill_gaps(own.groupBy("station", "ts").agg(F.max("value").alias("value")), fill)


def read_stacked(spark: SparkSession, path: str, stations: Sequence[str], date_column: int = 0, value_column: int = 1, delimiter: str | None = None) -> DataFrame:
    """SC-14: (file, station, ts, value) from files in which blocks of rows follow a line that has the station's name in a cell.

    A block ends at the next name or at a line with neither date nor value; of several blocks of a station in a file the
    longest counts, of equals the first. Each file is read by one task's line order, files are spread over the cluster.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    delimiter = delimiter or sniff_delimiter(spark.read.text(path).select("value").limit(50).toPandas()["value"].tolist())
    rows = lines.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).withColumn("cells", F.transform(F.split("line", f"[{delimiter}]"), lambda c: F.btrim(c)))
    name = F.get(F.filter("cells", lambda c: c.isin(list(stations))), F.lit(0))
    cell = lambda i: F.nullif(F.get("cells", F.lit(i)), F.lit(""))
    rows = rows.select("file", "n", name.alias("name"), cell(date_column).alias("ts"), cell(value_column).alias("value"))
    order = Window.partitionBy("file").orderBy("n")
    dated = F.col("ts").rlike(DATE) | F.col("value").try_cast("double").isNotNull()
    rows = rows.withColumn("cut", F.col("name").isNotNull() | ~F.coalesce(dated, F.lit(False)))
    # header lines right below a name don't end its block: a block starts at its first row with a date
    rows = rows.withColumns({"station": F.last("name", True).over(order), "block": F.sum(F.col("cut").cast("int")).over(order)}).filter(~F.col("cut") & F.col("station").isNotNull())
    sizes = rows.groupBy("file", "station", "block").agg(F.count("*").alias("size"))
    best = sizes.groupBy("file", "station").agg(F.max(F.struct("size", (-F.col("block")).alias("b"))).alias("m")).select("file", "station", (-F.col("m.b")).alias("block"))
    found = rows.join(best, ["file", "station", "block"]).select("file", "station", "ts", F.col("value").try_cast("double").alias("value"))
    return parsed_dates(found, ["ts"]).filter("ts IS NOT NULL")


def match_files(files: DataFrame, stations: DataFrame) -> DataFrame:
    """PF-14: (file, station): the only station whose name the file's name has, if no file before took it; else the first free one of several.

    A name may be part of another; they go by place in the file's name, longer names first. Both tables are small lists.
    """
    base = F.lower(F.regexp_extract("file", r"([^/]*)$", 1))
    met = files.select("file", base.alias("base")).join(stations.select("station"), F.contains(base, F.lower("station")))
    ranked = met.withColumn("m", F.struct(F.instr("base", F.lower("station")).alias("at"), (-F.char_length("station")).alias("l"), "station"))
    listed = ranked.groupBy("file").agg(F.sort_array(F.collect_list("m")).alias("m"), F.count("*").alias("n"))
    sure = listed.filter("n = 1").select("file", F.get("m", F.lit(0))["station"].alias("station")).groupBy("station").agg(F.min("file").alias("file"))
    free = listed.filter("n > 1").select("file", F.posexplode("m").alias("k", "m")).select("file", "k", "m.station").join(sure.select("station"), "station", "left_anti")
    first = free.groupBy("file").agg(F.min(F.struct("k", "station")).alias("m")).select("file", F.col("m.station").alias("station")).groupBy("station").agg(F.min("file").alias("file"))
    return files.select("file").join(sure.unionByName(first), "file", "left")
