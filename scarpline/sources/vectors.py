"""Vector layers: GeoJSON collections as tables of rings, and back; selections of features by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarpline.operators.polygons import POINTS, clean_ring

RING = "array<array<array<double>>>"


def read_geojson(spark: SparkSession, path: str, field: str | None = None, values: Sequence[str] | None = None, only_polygons: bool = True, points_limit: int = 80000) -> DataFrame:
    """SC-8, SC-9, SC-10: (feature, class_name, kind, rings), rings of (part, hole, ring), from feature collections.

    class_name is the feature's property `field`; with values, other classes go and a value that no feature has raises an
    error when the rows are read. Empty geometries, those of more vertices than the limit and, unless asked for,
    lines and points go. A file is one JSON text; files are spread over the cluster.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>")).alias("f"))
    own = raw.select(F.concat_ws("#", "file", F.monotonically_increasing_id().cast("string")).alias("feature"), (F.try_element_at("f.properties", F.lit(field)) if field else F.lit(None).cast("string")).alias("class_name"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("at"))
    if values is not None:
        known = own.select("class_name").filter(F.col("class_name").isin(list(values))).distinct()
        missing = known.agg(F.array_except(F.array(*map(F.lit, values)), F.collect_set("class_name")).alias("m")).first()["m"]
        if missing:
            raise ValueError(f"no feature of the classes {missing}")
        own = own.filter(F.col("class_name").isin(list(values)))
    parts = F.when(F.col("kind") == "Polygon", F.array(F.from_json("at", RING))).when(F.col("kind") == "MultiPolygon", F.from_json("at", f"array<{RING}>")).when(F.col("kind") == "LineString", F.array(F.array(F.from_json("at", "array<array<double>>")))).when(F.col("kind") == "MultiLineString", F.array(F.from_json("at", RING))).when(F.col("kind") == "Point", F.array(F.array(F.array(F.from_json("at", "array<double>"))))).when(F.col("kind") == "MultiPoint", F.array(F.array(F.from_json("at", "array<array<double>>"))))
    points = lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    rings = F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda r, k: F.struct(i.alias("part"), (k > 0).alias("hole"), points(r).alias("ring")))))
    out = own.select("feature", "class_name", "kind", rings.alias("rings")).filter(F.size("rings") > 0)
    count = F.aggregate("rings", F.lit(0), lambda acc, r: acc + F.size(r["ring"]))
    out = out.filter(count.between(1, points_limit))
    return out.filter(F.col("kind").isin("Polygon", "MultiPolygon")) if only_polygons else out


def polygon_rings(features: DataFrame, by: str = "feature") -> DataFrame:
    """VE-7: rings (poly_id, part, hole, ring) of features, or of all those of one class; holes and parts without three points go."""
    each = features.select(F.col(by).alias("poly_id"), F.explode("rings").alias("r"))
    return each.select("poly_id", "r.part", "r.hole", clean_ring(F.col("r.ring").cast(POINTS)).alias("ring")).filter(F.size("ring") > 0)


def field_values(features: DataFrame) -> DataFrame:
    """SC-11: the distinct classes, sorted."""
    return features.select("class_name").filter("class_name IS NOT NULL").distinct().orderBy("class_name")


def to_geojson(rings: DataFrame) -> DataFrame:
    """SK-11: one feature per row as JSON text (poly_id, value), rings closed; holes follow their part's outer ring."""
    closed = F.transform(F.concat("ring", F.slice("ring", 1, 1)), lambda p: F.array(p["x"], p["y"]))
    parts = rings.groupBy("poly_id", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("hole", closed.alias("c")))), lambda s: s["c"]).alias("c"))
    polys = parts.groupBy("poly_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "c"))), lambda s: s["c"]).alias("coordinates"))
    shape = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("poly_id")).alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), "coordinates").alias("geometry"))
    return polys.select("poly_id", F.to_json(shape).alias("value"))
