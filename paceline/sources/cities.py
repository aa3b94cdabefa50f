"""City coordinates as a small dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline import fixed_values as V

SCHEMA = "name string, lat double, lng double, region string"


def city_dim(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """The fixed cities plus rows of ``extra`` whose name is not there yet."""
    fixed = spark.createDataFrame(list(V.CITY_COORDINATES), SCHEMA)
    if extra is None:
        return fixed
    known = F.col("name").isin([row[0] for row in V.CITY_COORDINATES])
    added = (
        extra.filter(F.col("name").isNotNull() & ~known & F.col("lat").isNotNull() & F.col("lng").isNotNull())
        .groupBy("name")
        .agg(F.min(F.struct("lat", "lng", "region")).alias("r"))
        .select("name", "r.lat", "r.lng", "r.region")
    )
    return fixed.unionByName(added)
