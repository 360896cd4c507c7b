"""The standard and parameter classes that come with the library, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Per type its prefix and class names, numbered from 0.
STANDARD = {
    "soil_sub": ("ssl", ("Unknown", "Cohesive soil", "Soft non-cohesive soil", "Non-cohesive soil", "Rock", "Strong rock")),
    "soil_top": ("tsl", ("Unknown", "Clay", "Silty clay", "Clay loam", "Loam", "Silty clay loam", "Silt loam", "Silt", "Sandy clay", "Sandy clay loam", "Loamy sand", "Sandy loam", "Sand")),
    "vegetation": ("veg", ("Unknown", "Grass", "Bush", "Low tree", "Medium tree", "High tree", "Very high and robust tree")),
    "land_use": ("lnd", ("Unknown", "Bare soil", "Sloping man-made areas", "Mountainous and rocky areas", "Various crops", "Low vegetation and meadows", "Woods (Forests)", "Flat man-made areas", "Submerged areas")),
}
#: Parameters with their units, and their values by class, numbered from 1.
UNITS = {"GS": "-", "gd": "kN/m3", "c": "kPa", "cr": "kPa", "phi": "deg", "kt": "m/h", "beta": "-", "A": "-", "n": "-", "E": "MPa", "ni": "-"}
SOIL = (
    (2.65, 16.5, 0, 0, 32, 1e-2, 1, 40, 0.4, 20, 0.30),
    (2.67, 18.0, 0, 0, 38, 5e-3, 1, 40, 0.35, 60, 0.25),
    (2.65, 17.5, 5, 0, 18, 1e-3, 1, 80, 0.45, 20, 0.35),
    (2.68, 18.0, 10, 0, 22, 5e-4, 1, 80, 0.48, 15, 0.30),
    (2.70, 15.0, 15, 0, 20, 1e-4, 1, 100, 0.52, 10, 0.35),
    (2.72, 19.0, 25, 0, 25, 5e-5, 1, 100, 0.45, 30, 0.30),
    (2.65, 25.0, 3e4, 0, 35, 1e-3, 1, 40, 0.25, 1e4, 0.20),
    (2.60, 18.0, 0, 0, 40, 2e-2, 1, 40, 0.3, 120, 0.27),
)
VEGETATION = (
    (0, 0, 0, 2, 0, 0, 0.5, 0, 0, 0, 0),
    (0, 0, 0, 5, 0, 0, 0.6, 0, 0, 0, 0),
    (0, 0, 0, 10, 0, 0, 0.6, 0, 0, 0, 0),
    (0, 0, 0, 15, 0, 0, 0.6, 0, 0, 0, 0),
    (0, 0, 0, 20, 0, 0, 0.6, 0, 0, 0, 0),
)
#: Valid ranges, filling and aggregation of the kinds of series.
SERIES_KINDS = {"rain": (0.0, None, "zero", "sum"), "temperature": (-50.0, 50.0, "linear", "mean")}


def standard_classes(spark: SparkSession) -> DataFrame:
    """SK-7: (type, class_name, class_id, class_num)."""
    rows = [(kind, name, f"{prefix}{i:02d}", i) for kind, (prefix, names) in STANDARD.items() for i, name in enumerate(names)]
    return spark.createDataFrame(rows, "type string, class_name string, class_id string, class_num int")


def parameter_classes(spark: SparkSession) -> DataFrame:
    """SK-7: (type, class_id, class_num) and a double for each parameter; units are in UNITS, not a row among the numbers."""
    rows = [(kind, f"{prefix}{i:02d}", i, *map(float, values)) for kind, prefix, table in (("soil", "slp", SOIL), ("vegetation", "vgp", VEGETATION)) for i, values in enumerate(table, 1)]
    return spark.createDataFrame(rows, "type string, class_id string, class_num int, " + ", ".join(f"`{k}` double" for k in UNITS))
