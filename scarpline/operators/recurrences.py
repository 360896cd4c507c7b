"""Recurrences and splines over long series: no task holds a whole series.

A recurrence x[t] = a[t] x[t-1] + b[t] runs along the sorted rows of its task, which pass it as a stream, and hands its last x from one block
of rows to the next. A tridiagonal system is solved in blocks that are dealt to tasks: in each, every unknown is p + q L + r R of the unknowns
before and behind the block, those at the blocks' ends are solved from a system of two rows a block, and put in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scarpline.operators.batches import by_groups

KEYS = ("station",)
BLOCK = 4096


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {dict(df.dtypes)[n]}" for n in names)


def affine_scan(rows: DataFrame, names: Sequence[str], keys: Sequence[str] = KEYS, block: int = BLOCK, made: dict[str, Callable] | None = None) -> DataFrame:
    """Rows (keys, ts, t, others), t from 0 without gaps in the order of ts, with each name x instead of a_x and b_x: x[t] = a[t] x[t-1] + b[t].

    A row with a = 0 takes nothing from the rows before, also if these are null; the first row's a counts as 0. A null b makes x null.
    made makes a and b of a name in the task instead: it gives a function of t, value and whether there is one, which takes the rows in order.
    The rows should come from windows by keys in the order of ts: they stay where these have put them. block is how many a task takes up at a time.
    """
    made = made or {}
    given = [f"{m}_{n}" for n in names if n not in made for m in "ab"]
    kept = [c for c in rows.columns if c not in given]
    kinds = StructType([rows.schema[c] for c in kept] + [StructField(n, DoubleType()) for n in names])
    own = rows.withColumns({c: F.col(c).cast("double") for c in given})

    def run(batches):
        last, x = -1, dict.fromkeys(names, np.nan)
        maps = {n: make() for n, make in made.items()}
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                column = lambda c: part.column(c).to_numpy(zero_copy_only=False)  # noqa: B023,E731
                t = column("t")
                if ((t != 0) & (t != np.r_[last, t[:-1]] + 1)).any():
                    raise ValueError("the rows of a series are not in order")
                last, found = t[-1], []
                value = part.column("value").cast(pa.float64()) if maps else None
                for n in names:
                    a, b = maps[n](t, value.to_numpy(zero_copy_only=False), value.is_valid().to_numpy(zero_copy_only=False)) if n in maps else (column(f"a_{n}"), column(f"b_{n}"))
                    now, out = x[n], []
                    for p, q in zip(np.where(t == 0, 0.0, a).tolist(), b.tolist()):
                        now = q if p == 0 else p * now + q
                        out.append(now)
                    x[n] = now
                    found.append(pa.array(np.array(out), pa.float64(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + found, [*kept, *names])

    return own.sortWithinPartitions(*keys, "ts").mapInArrow(run, kinds)


def _several(ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of blocks of those series that have more than one: only these take anything from others."""
    return ends.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n > 1").drop("_n")


def _thomas(a, b, c, d) -> np.ndarray:
    """Solves a tridiagonal system for several right sides (columns of d)."""
    n, cp, dp = len(b), np.empty(len(b)), np.empty_like(d)
    cp[0], dp[0] = c[0] / b[0], d[0] / b[0]
    for i in range(1, n):
        m = b[i] - a[i] * cp[i - 1]
        cp[i] = c[i] / m
        dp[i] = (d[i] - a[i] * dp[i - 1]) / m
    for i in range(n - 2, -1, -1):
        dp[i] -= cp[i] * dp[i + 1]
    return dp


def solve_tridiagonal(rows: DataFrame, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """(keys, k, m) of the systems a[k] m[k-1] + b[k] m[k] + c[k] m[k+1] = d[k] of rows (keys, k, a, b, c, d), k from 0 without gaps.

    a of the first and c of the last row are taken as 0. The systems should be diagonally dominant, as those of splines are.
    """
    order = Window.partitionBy(*keys)
    own = rows.select(*keys, F.col("k").cast("long").alias("k"), *[F.col(c).cast("double").alias(c) for c in "abcd"]).withColumn("_last", F.max("k").over(order) == F.col("k")).withColumn("_b", F.floor(F.col("k") / block))

    def run(columns, first, last):
        out = {n: columns[n][first:last] for n in (*keys, "_b", "k")}
        a, b, c, d = (columns[n][first:last].astype(float) for n in "abcd")
        a[0] = 0.0 if out["k"][0] == 0 else a[0]
        c[-1] = 0.0 if columns["_last"][last - 1] else c[-1]
        right = np.zeros((len(b), 3))
        right[:, 0], right[0, 1], right[-1, 2] = d, -a[0], -c[-1]
        p = _thomas(np.r_[0.0, a[1:]], b, np.r_[c[:-1], 0.0], right)
        return out | dict(zip("pqr", p.T))

    found = by_groups(own, [*keys, "_b"], ["k"], run, _fields(own, [*keys, "_b", "k"]) + ", p double, q double, r double")
    row = F.struct("p", "q", "r")
    ends = found.groupBy(*keys, "_b").agg(F.min_by(row, "k").alias("f"), F.max_by(row, "k").alias("l"))
    flat = _several(ends, keys).select(*keys, "_b", *[F.col(f"{e}.{c}").alias(f"{e}{c}") for e in "fl" for c in "pqr"])

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b", ignore_index=True)
        n = len(pdf)
        left, right = np.zeros(n), np.zeros(n)
        if n > 1:
            # first = fp + fq L + fr R and last = lp + lq L + lr R, where L is the last of the block before and R the first of the next:
            # going on, last = u - v R, and so first of the next is linked to R behind it
            u, v = np.zeros(n), np.zeros(n)
            fp, fq, fr, lp, lq, lr = (pdf[c].to_numpy() for c in ("fp", "fq", "fr", "lp", "lq", "lr"))
            s, t = np.zeros(n), np.zeros(n)  # first = s + t R
            s[0], t[0], u[0], v[0] = fp[0], fr[0], lp[0], lr[0]
            for i in range(1, n):
                # L = u + v first, first = fp + fq L + fr R
                m = 1 - fq[i] * v[i - 1]
                s[i], t[i] = (fp[i] + fq[i] * u[i - 1]) / m, fr[i] / m
                u[i], v[i] = lp[i] + lq[i] * (u[i - 1] + v[i - 1] * s[i]), lr[i] + lq[i] * v[i - 1] * t[i]
            first = s[-1]
            for i in range(n - 1, 0, -1):
                left[i], right[i - 1] = u[i - 1] + v[i - 1] * first, first
                first = s[i - 1] + t[i - 1] * first
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "_b": pdf["_b"], "_l": left, "_r": right})

    outer = flat.groupBy(*keys).applyInPandas(reduced, _fields(flat, [*keys, "_b"]) + ", _l double, _r double")
    beside = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return found.join(outer, [*keys, "_b"], "left").select(*keys, "k", (F.col("p") + F.col("q") * beside("_l") + F.col("r") * beside("_r")).alias("m"))


def _known(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows with a value: x (row number in the series), y, k (number among them), n of them, and steps and slopes on both sides."""
    own = series.filter("value IS NOT NULL").select(*keys, F.col("_i").cast("double").alias("x"), F.col("value").cast("double").alias("y"))
    order = Window.partitionBy(*keys).orderBy("x")
    own = own.withColumns({"k": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy(*keys)), "h": F.lead("x").over(order) - F.col("x"), "dy": (F.lead("y").over(order) - F.col("y")) / (F.lead("x").over(order) - F.col("x"))})
    return own.withColumns({"g": F.lag("h").over(order), "ey": F.lag("dy").over(order)})


def _cubic(known: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """The cubic (c0, c1, c2, c3) of x from each known row to the next one: a spline whose first two and last two cubics are the same."""
    k, n, g, h = (F.col(c) for c in ("k", "n", "g", "h"))
    first, last = k == 1, k == n - 2
    # second derivatives at the inner rows; those at the ends go into their neighbours' equations
    diagonal = 2 * (g + h) + F.when(first, g * (g + h) / h).otherwise(0) + F.when(last, h * (g + h) / g).otherwise(0)
    below = F.when(first, 0.0).when(last, g - h * h / g).otherwise(g)
    above = F.when(last, 0.0).when(first, h - g * g / h).otherwise(h)
    inner = known.filter((n >= 4) & (k >= 1) & (k <= n - 2))
    system = inner.select(*keys, (k - 1).alias("k"), below.alias("a"), diagonal.alias("b"), above.alias("c"), (6 * (F.col("dy") - F.col("ey"))).alias("d"))
    order = Window.partitionBy(*keys).orderBy("k")
    m = known.filter(n >= 4).join(solve_tridiagonal(system, keys, block).withColumn("k", (F.col("k") + 1).cast("int")), [*keys, "k"], "left")
    at = lambda c, i: (F.lead(c, i) if i > 0 else F.lag(c, -i)).over(order)
    ahead = ((h + at("h", 1)) * at("m", 1) - h * at("m", 2)) / at("h", 1)
    behind = ((g + at("g", -1)) * at("m", -1) - g * at("m", -2)) / at("g", -1)
    m = m.withColumn("m", F.when(k == 0, ahead).when(k == n - 1, behind).otherwise(F.col("m")))
    nxt = F.lead("m").over(order)
    c1 = F.col("dy") - h * (2 * F.col("m") + nxt) / 6
    return m.select(*keys, "x", F.struct(F.col("x").alias("o"), F.col("y").alias("c0"), c1.alias("c1"), (F.col("m") / 2).alias("c2"), ((nxt - F.col("m")) / (6 * h)).alias("c3")).alias("near"), F.lit(None).cast("double").alias("turn")).withColumn("far", F.col("near"))


def _quadratic(known: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """The parabolas of x before (near) and behind (far) the middle (turn) between each known row and the next one; those of the first and last two rows are the same."""
    k, n, g, h = (F.col(c) for c in ("k", "n", "g", "h"))
    order = Window.partitionBy(*keys).orderBy("k")
    after = F.lead("h").over(order)
    # slopes at the middles; the first and the last one are those of the chords
    end = (k == 0) | (k == n - 2)
    rows = known.filter(n >= 3).withColumn("after", after).filter(k <= n - 2)
    a, c = F.when(end, 0.0).otherwise(h / (g + h)), F.when(end, 0.0).otherwise(h / (h + F.col("after")))
    b = F.when(end, 1.0).otherwise(g / (g + h) + 2 + F.col("after") / (h + F.col("after")))
    system = rows.select(*keys, "k", a.alias("a"), b.alias("b"), c.alias("c"), F.when(end, F.col("dy")).otherwise(4 * F.col("dy")).alias("d"))
    m = known.filter(n >= 3).join(solve_tridiagonal(system, keys, block).withColumn("k", F.col("k").cast("int")), [*keys, "k"], "left")
    before = F.lag("m").over(order)
    own = F.struct(F.col("x").alias("o"), F.col("y").alias("c0"), ((before * h + F.col("m") * g) / (g + h)).alias("c1"), ((F.col("m") - before) / (g + h)).alias("c2"), F.lit(0.0).alias("c3"))
    p = m.withColumn("own", F.when((k > 0) & (k < n - 1), own))
    following = F.lead("own").over(order)
    return p.select(*keys, "x", F.coalesce("own", following).alias("near"), F.coalesce(following, F.col("own")).alias("far"), (F.col("x") + h / 2).alias("turn"))


def spline_fill(series: DataFrame, method: str, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """WN-9: nulls of value between known values by a quadratic or cubic spline over the numbers of the rows; both ends stay null.

    The quadratic one has its knots midway between known rows, without the first and the last of these; the cubic one at known rows without
    the second and the last but one. A series with fewer than three (four) known values stays as it is.
    """
    order = Window.partitionBy(*keys).orderBy("ts")
    numbered = series.withColumn("_i", F.row_number().over(order).cast("double"))
    known = _known(numbered, keys)
    curves = {"quadratic": _quadratic, "cubic": _cubic}[method](known, keys, block).withColumnRenamed("x", "_i").withColumn("_has", F.lit(True))
    met = numbered.join(curves, [*keys, "_i"], "left")
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("_c", F.last(F.when(F.col("_has"), F.struct("near", "far", "turn")), True).over(back))
    piece = F.when(F.col("_c.turn").isNull() | (F.col("_i") <= F.col("_c.turn")), F.col("_c.near")).otherwise(F.col("_c.far"))
    met = met.withColumn("_p", piece)
    t = F.col("_i") - F.col("_p.o")
    value = F.col("_p.c0") + t * (F.col("_p.c1") + t * (F.col("_p.c2") + t * F.col("_p.c3")))
    ahead = F.last("value", True).over(Window.partitionBy(*keys).orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("_ahead", ahead)
    return met.withColumn("value", F.coalesce("value", F.when(F.col("_ahead").isNotNull(), value))).select(*series.columns)


def fill_times(series: DataFrame, order_by: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """WN-14: null ts between known ones, linear over the order of the rows; null ts behind the last one take it, those before the first stay."""
    order = Window.partitionBy(*keys).orderBy(order_by)
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy(F.desc(order_by)).rowsBetween(Window.unboundedPreceding, 0)
    at = series.withColumn("_i", F.row_number().over(order))
    here = F.when(F.col("ts").isNotNull(), F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("m"), F.col("_i").alias("i")))
    at = at.withColumn("_h", here).withColumns({"_p": F.last("_h", True).over(back), "_n": F.last("_h", True).over(ahead)})
    share = (F.col("_i") - F.col("_p.i")) / F.nullif(F.col("_n.i") - F.col("_p.i"), F.lit(0))
    micros = F.col("_p.m") + F.coalesce(F.round((F.col("_n.m") - F.col("_p.m")) * share), F.lit(0)).cast("long")
    kind = dict(series.dtypes)["ts"]
    return at.withColumn("ts", F.coalesce("ts", F.timestamp_micros(micros).cast(kind))).select(*series.columns)


def _exponential(at: DataFrame, n: int, order) -> DataFrame:
    alpha = 2 / (n + 1)
    last = F.last(F.when(F.col("value").isNotNull(), F.col("t")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    weight = F.pow(F.lit(1 - alpha), (F.col("t") - F.col("_last")).cast("double"))
    gap, new = F.col("value").isNull(), F.col("_last").isNull()
    a = F.when(new, 0.0).when(gap, 1.0).otherwise(weight / (weight + alpha))
    b = F.when(new, F.col("value")).when(gap, 0.0).otherwise(alpha * F.col("value") / (weight + alpha))
    return at.withColumn("_last", last).withColumns({"a_exponential": a, "b_exponential": b}).drop("_last")


def _adaptive_maps(n: int):
    """The recurrence of WN-7 for rows that come in order; the n rows before are remembered."""
    past, known = np.zeros(n), np.zeros(n, bool)

    def maps(t, value, has):
        nonlocal past, known
        m = len(t)
        v, h = np.r_[past, np.where(has, value, 0.0)], np.r_[known, has]
        total, count, steps, whole, before = np.zeros(m), np.zeros(m), np.zeros(m), t >= n, h[:m] & (t >= n)
        for j in range(n - 1, -1, -1):  # the oldest first
            at, ahead = slice(n - j, n - j + m), slice(n - j - 1, n - j - 1 + m)
            own = h[at] & (t >= j)
            total += np.where(own, v[at], 0.0)
            count += own
            steps += np.abs(v[at] - v[ahead])
            whole &= h[at] & h[ahead]
            if j:
                before |= own
        with np.errstate(divide="ignore", invalid="ignore"):
            simple = total / count
            ratio = np.where(whole & (steps != 0), np.abs(v[n:] - v[:m]) / steps, 0.0)
        s = (ratio * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        goes = (t >= n) & has & before
        past, known = v[m:], h[m:]
        return np.where(goes, 1 - s, 0.0), np.where(goes, s * value, simple)

    return maps


def averages(series: DataFrame, n: int, keys: Sequence[str] = KEYS, names: Sequence[str] = ("exponential", "adaptive"), block: int = BLOCK) -> DataFrame:
    """WN-3, WN-7: adds the named averages. The rows of a series are sorted once, and no table is joined to itself."""
    order = Window.partitionBy(*keys).orderBy("ts")
    at = series.withColumn("t", F.row_number().over(order) - 1)
    if "exponential" in names:
        at = _exponential(at, n, order)
    made = {"adaptive": partial(_adaptive_maps, n)} if "adaptive" in names else {}
    return affine_scan(at, names, keys, block, made).drop("t")


def exponential(series: DataFrame, n: int, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """WN-3: adds exponential, the average of span n; gaps age the weight of what came before."""
    return averages(series, n, keys, ("exponential",), block)


def adaptive(series: DataFrame, n: int, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """WN-7: adds adaptive: the simple average of n rows, corrected by how straight the last n steps went."""
    return averages(series, n, keys, ("adaptive",), block)
