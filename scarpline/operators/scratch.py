"""Cutting the lineage of iterative operators in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables of at most so many rows are broadcast; larger ones are left to Spark.
BROADCAST_ROWS = 50_000


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir; only a local session may do without that setting."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="scarpline-"))
    return df.checkpoint()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table to be broadcast in a join if a count shows that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def by_size(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table to be joined many times: broadcast if a count shows that it is small, else merged, as Spark takes a stored table for smaller than it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")
