"""A synthetic cube of any size for trying things out."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from isograd.model import Cube
from isograd.session import prepare

# First day and value distributions of the synthetic cube.
FIRST_DAY = "2014-09-06"
REFERENCE_TIME = "2014-09-05"
TEMPERATURE_MEAN, TEMPERATURE_STD = 15.0, 8.0
PRECIPITATION_MAX = 10.0


def dummy_ds(spark: SparkSession, lon_dim: int = 360, lat_dim: int = 180, time_dim: int = 5,
             seed: int = 0) -> Cube:
    """Normal temperatures and uniform precipitation on a global grid of daily cells."""
    prepare(spark)
    i = F.col("id")
    x, y, t = i % lon_dim, F.floor(i / lon_dim) % lat_dim, F.floor(i / (lon_dim * lat_dim))
    rows = spark.range(lon_dim * lat_dim * time_dim).select(
        F.date_add(F.lit(FIRST_DAY).cast("date"), t.cast("int")).cast("timestamp_ntz")
        .alias("time"),
        (F.lit(-90.0) + (y + 0.5) * F.lit(180.0 / lat_dim)).alias("lat"),
        (F.lit(-180.0) + (x + 0.5) * F.lit(360.0 / lon_dim)).alias("lon"),
        (F.lit(TEMPERATURE_MEAN) + F.lit(TEMPERATURE_STD) * F.randn(seed)).alias("temperature"),
        (F.lit(PRECIPITATION_MAX) * F.rand(seed + 1)).alias("precipitation"))
    return Cube.of(rows, ("time", "lat", "lon"), attrs={"reference_time": REFERENCE_TIME})
