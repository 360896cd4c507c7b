"""The Spark session settings that the operators expect."""

from pyspark.sql import SparkSession


def get_session(name: str = "scarpline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by name with dots as underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
