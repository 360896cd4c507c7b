"""Document quality and toxicity by co-training two views.

The text view sees the text alone: hashed words, shares of marks, and how it is laid out. The page view sees the row's other columns
alone: source, lang and stated size, and pairs of these. Both are naive Bayes models over hashed features, so fitting is a sum of counts that Spark
pre-aggregates over all documents. In each round a view labels the documents without labels that it is sure of, and
the other learns from them. Scores are calibrated on labelled documents held out from fitting, then added as log odds.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.llm.common import rows_of, stored

BITS, ROUNDS, SURE, SMOOTH, BINS, CHI2 = 18, 2, 4.0, 0.5, 40, 20.0
PSEUDO_WEIGHT = 0.25
#: Tables of at most so many labels are broadcast; larger ones are shuffled with the features.
BROADCAST_ROWS = 500_000
WORD, SHAPE = re.compile(r"[^\W\d_]+"), re.compile(r"[^\w\s]")
TARGETS, VIEWS = ("quality", "toxic"), ("text", "page")


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


class _Slots(dict):
    def __missing__(self, feature: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[feature] = _slot(feature)
        return value


def _share(part: float, whole: float) -> int:
    """A share as one of eight bins, finer near nothing."""
    return min(7, int(8 * math.sqrt(part / whole))) if whole else 0


def text_features(text: str, slots: _Slots) -> list[int]:
    words = WORD.findall(text.lower())
    own = {slots[w] for w in words}
    own.update(slots[f"shape {s} {_share(n, len(words))}"] for s in "%#*$&|.,;:" if (n := text.count(s)))
    tokens, lines = text.split(), text.split("\n")
    n, marks = len(text), len(SHAPE.findall(text))
    laid = [f"lines {int(math.log2(len(lines)))}", f"marks {_share(marks, n)}", f"distinct {_share(len(set(tokens)), len(tokens))}", f"line {int(math.log2(n / len(lines) + 1))}", f"word {int(2 * n / (len(tokens) + 1))}", f"same lines {_share(len(lines) - len(set(lines)), len(lines))}", f"repeats {_share(sum(a == b for a, b in zip(tokens, tokens[1:])), len(tokens))}"]
    own.update(slots[f"layout {k}"] for k in laid)
    return sorted(own)


def page_features(n_chars: int | None, lang: str | None, source: str | None, slots: _Slots) -> list[int]:
    size = None if n_chars is None else int(2 * math.log2(max(0, n_chars) + 1))
    kept = [f"source {source}", f"lang {lang}", f"size {size}", f"source {source} lang {lang}", f"source {source} size {size}"]
    return sorted({slots[f"page {k}"] for k in kept})


def _featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots = _Slots()
    for rows in rows_of(batches):
        texts = [t or "" for t in rows["text"]]
        words = [text_features(t, slots) for t in texts]
        page = [page_features(n, a, s, slots) for n, a, s in zip(rows["n_chars"], rows["lang"], rows["source"])]
        yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(words, pa.list_(pa.int32())), pa.array(page, pa.list_(pa.int32()))], ["doc_id", "text_view", "page_view"])


def featured(docs: DataFrame) -> DataFrame:
    size = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long").alias("n_chars")
    own = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.col("source").cast("string"), size)
    return own.mapInArrow(_featured, "doc_id long, text_view array<int>, page_view array<int>")


def _weights(yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """Log odds by slot from weighted counts, the last slot being the prior."""
    n_yes, n_no = yes[-1] + 2 * SMOOTH, no[-1] + 2 * SMOOTH
    weights = np.log((yes + SMOOTH) / n_yes) - np.log((no + SMOOTH) / n_no)
    expected = (yes + no) * n_yes / (n_yes + n_no)
    chi2 = (yes - expected) ** 2 / np.maximum(expected * n_no / (n_yes + n_no), 1e-9)
    weights[chi2 < CHI2] = 0.0  # many features without a clear bias would drown a few with one
    weights[-1] = math.log(n_yes / n_no)
    return weights


def _fit(rows: DataFrame) -> dict[tuple[str, str], np.ndarray]:
    """The models of both targets and views from one pass over rows with the columns <target>_<view>_y (0, 1, null) and _w.

    Counts are summed by view and slot in Spark, map-side first; 2 * (2^BITS + 1) sums come to the driver at most.
    """
    size = (1 << BITS) + 1
    with_prior = lambda view: F.concat(F.array(F.lit(size - 1)), f"{view}_view")
    names = [(t, v) for t in TARGETS for v in VIEWS]
    labels = [F.col(f"{t}_{v}_{k}") for t, v in names for k in "yw"]
    each = rows.select(*labels, F.explode(F.array(*[F.struct(F.lit(v).alias("view"), with_prior(v).alias("slots")) for v in VIEWS])).alias("x"))
    of_view = lambda t, k: F.when(F.col("x.view") == VIEWS[0], F.col(f"{t}_{VIEWS[0]}_{k}")).otherwise(F.col(f"{t}_{VIEWS[1]}_{k}")).alias(f"{t}_{k}")
    flat = each.select("x.view", *[of_view(t, k) for t in TARGETS for k in "yw"], "x.slots").filter(" OR ".join(f"{t}_y IS NOT NULL" for t in TARGETS))
    sums = [F.sum(F.when(F.col(f"{t}_y") == y, F.col(f"{t}_w")).otherwise(0.0)).alias(f"{t}_{y}") for t in TARGETS for y in (1, 0)]
    counts = flat.select("view", *[f"{t}_{k}" for t in TARGETS for k in "yw"], F.explode("slots").alias("slot")).groupBy("view", "slot").agg(*sums).toPandas()
    out = {}
    for t, v in names:
        own = counts[counts["view"] == v]
        yes, no = np.zeros(size), np.zeros(size)
        yes[own["slot"]], no[own["slot"]] = own[f"{t}_1"], own[f"{t}_0"]
        out[t, v] = _weights(yes, no)
    return out


def _scored(batches: Iterable[pa.RecordBatch], models) -> Iterator[pa.RecordBatch]:
    """Adds the sum of weights over each view's features, for each model (name, view, weights)."""
    for batch in batches:
        arrays, names = list(batch.columns), list(batch.schema.names)
        for name, view, weights in models.value:
            column = batch.column(names.index(view))
            flat, offsets = column.flatten().to_numpy(), np.asarray(column.value_lengths().fill_null(0))
            sums = np.zeros(len(offsets) + 1)
            ends = np.cumsum(offsets)
            total = np.concatenate([[0.0], np.cumsum(weights[flat])])
            sums = total[ends] - total[ends - offsets]
            arrays.append(pa.array(sums + weights[-1]))
            names.append(name)
        yield pa.RecordBatch.from_arrays(arrays, names)


def _with_scores(rows: DataFrame, models: list[tuple[str, str, np.ndarray]]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(models)
    extra = ", ".join(f"{name} double" for name, _, _ in models)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(lambda it: _scored(it, sent), f"{fields}, {extra}")


def _calibrated(rows: DataFrame, score: str, label: str) -> tuple[float, float]:
    """Slope and offset of log odds over a score, from its histogram on held-out labelled rows."""
    binned = rows.filter(F.col(label).isNotNull()).select(F.least(F.greatest(F.round(F.signum(score) * F.log1p(F.abs(score)) * 5), F.lit(-BINS)), F.lit(BINS)).alias("bin"), F.col(score).alias("x"), F.col(label).alias("y"))
    data = [(x, y, n) for _, x, y, n in binned.groupBy("bin").agg(F.avg("x"), F.avg("y"), F.count("*")).collect()]
    if not data:
        return 1.0, 0.0
    x, y, n = map(np.array, zip(*data))
    scale = max(1e-9, float(np.abs(x).max()))
    x, n_all = x / scale, n.sum()
    slope, offset = 1.0, 0.0
    for _ in range(200):  # Newton steps with a small prior, so that separable data settle
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        g = np.array([np.sum(n * (y - p) * x) - 1e-2 * slope, np.sum(n * (y - p)) - 1e-2 * offset])
        w = n * p * (1 - p)
        h = np.array([[np.sum(w * x * x) + 1e-2, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-2]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        slope, offset = slope + step[0], offset + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return slope / scale, offset


def score_documents(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """One row per document row: doc_id, quality and toxic (probabilities), keep (quality >= 0.5 and toxic < 0.5), labelled.

    labels: doc_id, quality, toxic (0, 1 or null; of repeated rows the largest counts). A fifth of the labelled
    documents, by a hash of doc_id, is used to calibrate only. Null texts are empty, null metadata are values of their
    own (n_chars may be left out), other columns are ignored; an empty table gives an empty one. Without labels every probability is 0.5 or the
    prior's. All documents are scored and may give pseudo-labels.
    """
    label = lambda c: F.when(F.col(c).isin(0, 1), F.col(c).cast("int"))
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), label("quality").alias("quality"), label("toxic").alias("toxic")).groupBy("label_id").agg(F.max("quality").alias("y_quality"), F.max("toxic").alias("y_toxic"))
    rows, known = featured(docs), stored(known)
    rows = rows.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, F.col("doc_id") == F.col("label_id"), "left").drop("label_id").withColumn("own_fold", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0, F.lit(False)))
    rows = stored(rows)
    held_rows = rows.filter(F.col("own_fold") & (F.col("y_quality").isNotNull() | F.col("y_toxic").isNotNull()))
    fitted: list[tuple[str, str, np.ndarray]] = []
    scale: dict[tuple[str, str], tuple[float, float]] = {}
    for r in range(rounds + 1):
        scored = _with_scores(rows, fitted) if r else rows
        taught = {}
        for t in TARGETS:
            y = F.when(~F.col("own_fold"), F.col(f"y_{t}"))
            for v, other in (VIEWS, VIEWS[::-1]):
                label, weight = y, F.lit(1.0)
                if r:  # what the other view is sure of, after its own calibration
                    a, b = scale[t, other]
                    odds = F.col(f"{t}_{other}") * float(a) + float(b)
                    label = F.coalesce(y, F.when(F.col(f"y_{t}").isNull() & (F.abs(odds) >= sure), (odds > 0).cast("int")))
                    weight = F.when(F.col(f"y_{t}").isNotNull(), 1.0).otherwise(PSEUDO_WEIGHT)
                taught |= {f"{t}_{v}_y": label, f"{t}_{v}_w": weight}
        models = _fit(scored.withColumns(taught))
        fitted = [(f"{t}_{v}", f"{v}_view", w) for (t, v), w in models.items()]
        held = stored(_with_scores(held_rows, fitted).drop("text_view", "page_view"))
        scale = {(t, v): _calibrated(held, f"{t}_{v}", f"y_{t}") for t, v in models}
    final = _with_scores(rows, fitted)
    # both views' calibrated log odds, weighed by a last calibration of their sum
    both = {t: sum(F.col(f"{t}_{v}") * float(scale[t, v][0]) + float(scale[t, v][1]) for v in VIEWS) for t in TARGETS}
    check = held.withColumns({f"{t}_both": both[t] for t in TARGETS})
    odds = {}
    for t in TARGETS:
        a, b = _calibrated(check, f"{t}_both", f"y_{t}")
        odds[t] = both[t] * float(a) + float(b)
    p = {t: F.round(1 / (1 + F.exp(-F.least(F.greatest(odds[t], F.lit(-30.0)), F.lit(30.0)))), 6) for t in TARGETS}
    return final.select("doc_id", p["quality"].alias("quality"), p["toxic"].alias("toxic"), ((p["quality"] >= 0.5) & (p["toxic"] < 0.5)).alias("keep"), (F.col("y_quality").isNotNull() | F.col("y_toxic").isNotNull()).alias("labelled"), F.col("own_fold").alias("held_out"))
