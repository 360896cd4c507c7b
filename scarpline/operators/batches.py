"""Groups of rows given to plain functions on arrays, many groups to a batch: no data frame is built for each."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _starts(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """The numbers of the rows that begin a group; nulls are one key."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for k in keys:
        codes = pd.factorize(pdf[k], use_na_sentinel=False)[0]
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def by_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], run: Callable, schema: str) -> DataFrame:
    """Rows of run(columns, first, last) for each group of equal keys, in the given order; columns are arrays and a group is their rows from first to before last.

    run gives a data frame's columns as a dictionary of arrays, or None for no rows. The groups are spread over spark.sql.shuffle.partitions tasks even where
    they are few bytes, as their work is not. A task holds a batch of rows and the group that goes on behind it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, *keys).sortWithinPartitions(*keys, *order)

    def each(batches):
        rest = None
        for pdf in _with_end(batches):
            if pdf is not None:
                rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
                at = _starts(rest, keys)
                if len(at) < 2:
                    continue
                now, rest = rest.iloc[: at[-1]], rest.iloc[at[-1] :].reset_index(drop=True)
                bounds = at
            elif rest is None or rest.empty:
                return
            else:
                now, bounds = rest, np.array([0, len(rest)])
            columns = {c: now[c].to_numpy() for c in now}
            found = [f for f in (run(columns, a, b) for a, b in zip(bounds.tolist(), bounds[1:].tolist())) if f is not None]
            if found:
                yield pd.DataFrame({c: np.concatenate([f[c] for f in found]) for c in found[0]})

    return dealt.mapInPandas(each, schema)


def _with_end(batches):
    yield from (b for b in batches if len(b))
    yield None
