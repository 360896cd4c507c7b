"""Helpers that the corpus operators share: scratch tables, reading and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = 1000
#: Tables of at most so many bytes are broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session, as in tests, may do without that setting: it gets a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="scarpline-checkpoint-"))
    return sc.getCheckpointDir()


@contextmanager
def shuffles_released(spark: SparkSession):
    """Queries run in here release their shuffle files when they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """Write a table that is read more than once to the shared folder and read it back.

    Columnar files take a fraction of what a checkpoint of rows takes, and lost executors recompute nothing. The files
    hold all that the shuffles led to, so these are released.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/scarpline-{uuid.uuid4().hex}"
    with shuffles_released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote. What was made of them has to be stored by then."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def bounded_broadcast(df: DataFrame, size: int) -> DataFrame:
    """Broadcasts a table whose measured size in bytes is small enough; a larger one is shuffled."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Arrow batches as lists by column, of BATCH_ROWS rows at most, which bounds a worker's memory; empty ones are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(at, BATCH_ROWS)
            yield {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}


def hex64(column) -> F.col:
    """A signed 64-bit number as 16 lowercase hex digits of its two's complement."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")
