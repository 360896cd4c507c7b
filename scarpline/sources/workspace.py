"""A workspace: datasets as Parquet folders with a manifest, a registry of inputs, and exports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarpline.sources.tables import upsert

MANIFEST = "dataset string, label string, saved timestamp"
REGISTRY = "custom_id string, path string, type string, subtype string, internal boolean"


def save(df: DataFrame, root: str, dataset: str, label: str | None = None, partition_by: Sequence[str] = ()) -> None:
    """SK-1, SK-3: writes a dataset in place of an older one and notes it in the manifest, which only grows."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/datasets/{dataset}")
    row = [(dataset, label or dataset, datetime.now(timezone.utc).replace(tzinfo=None))]
    df.sparkSession.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """SK-3, SK-4: the newest note on each dataset."""
    notes = spark.read.schema(MANIFEST).json(f"{root}/manifest")
    return notes.groupBy("dataset").agg(F.max_by("label", "saved").alias("label"), F.max("saved").alias("saved"))


def load(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """SK-2: a dataset that the manifest names."""
    if catalog(spark, root).filter(F.col("dataset") == dataset).isEmpty():
        raise KeyError(dataset)
    return spark.read.parquet(f"{root}/datasets/{dataset}")


def add_input(registry: DataFrame, path: str, kind: str, subtype: str | None = None, internal: bool = False, replace: bool = False) -> DataFrame:
    """SK-5: the registry with a file; its id is three letters of the type and the next number of these.

    A file of the same type and subtype raises an error, or is replaced and keeps its id.
    """
    prefix = kind[:3].upper()
    own = registry.filter((F.col("type") == kind) & F.col("subtype").eqNullSafe(F.lit(subtype))).select("custom_id").first()
    if own and not replace:
        raise ValueError(f"{kind}, {subtype} is there")
    last = registry.filter(F.col("custom_id").startswith(prefix)).agg(F.max(F.substring("custom_id", 4, 3).try_cast("int")).alias("n")).first()["n"] or 0
    row = [(own["custom_id"] if own else f"{prefix}{last + 1:03d}", path, kind, subtype, internal)]
    return upsert(registry, registry.sparkSession.createDataFrame(row, REGISTRY), ["type", "subtype"])


def input_paths(registry: DataFrame, kind: str, subtype: str | None = None) -> DataFrame:
    """SC-18, JN-14: (custom_id, path) of a type and, if given, a subtype."""
    own = registry.filter(F.col("type") == kind)
    return (own.filter(F.col("subtype") == subtype) if subtype is not None else own).select("custom_id", "path")


def export_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """SK-9, SK-10: CSV files with a header, in folders by key; arrays and structs as JSON text."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes])
    writer = (flat.repartition(*partition_by) if partition_by else flat).write.mode("overwrite").option("header", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def export_statistics(statistics: DataFrame, path: str, metric: str = "metric") -> None:
    """SK-9: one folder of statistics per metric."""
    export_csv(statistics, path, (metric,))
