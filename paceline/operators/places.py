"""Joins on places: city resolution and nearness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline import fixed_values as V
from paceline.functions import geo
from paceline.functions import text as T

CELL = 0.5  # degrees
COLUMNS = 720  # cells around the globe
CELL_ROWS = 20_000  # races of a cell that are joined in one piece


def _city_stats(races: DataFrame) -> DataFrame:
    """Per normalised city: average point and one region."""
    return races.groupBy(T.normalize_czech(F.col("city")).alias("norm_city")).agg(
        F.avg(F.when(F.col("lat").isNotNull(), F.col("lat"))).alias("avg_lat"),
        F.avg(F.when(F.col("lat").isNotNull(), F.col("lng"))).alias("avg_lng"),
        F.min("region").alias("any_region"),
    )


def resolve_cities(wanted: DataFrame, dim: DataFrame, races: DataFrame, column: str = "city") -> DataFrame:
    """Add ``lat``, ``lng``, ``region`` to rows naming a city.

    The dimension decides by exact name; else the average point of races in
    that city; the region likewise.  NULL where neither knows the city.
    """
    known = dim.select(F.col("name").alias(column), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.col("region").alias("_region"))
    keyed = wanted.join(known, column, "left").withColumn("norm_city", T.normalize_czech(F.col(column)))
    found = keyed.join(_city_stats(races), "norm_city", "left")
    return found.select(
        *wanted.columns,
        F.coalesce("_lat", "avg_lat").alias("lat"),
        F.when(F.col("_lat").isNotNull(), F.col("_lng")).otherwise(F.col("avg_lng")).alias("lng"),
        F.coalesce("_region", "any_region").alias("region"),
    )


def _rows(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / CELL), F.floor(high / CELL)))


def _columns(low: Column, high: Column) -> Column:
    """Cells of a stretch of longitude, each once, counted on across the date line."""
    first = F.floor(low / CELL)
    last = F.least(F.floor(high / CELL), first + COLUMNS - 1)
    return F.explode(F.transform(F.sequence(first, last), lambda c: F.pmod(c, F.lit(COLUMNS))))


def near_points(points: DataFrame, races: DataFrame, radius_m: float = V.RADIUS_M) -> DataFrame:
    """Races within the radius of each point: ``points`` columns, ``race_id``, ``dist_m``.

    Points (``point_id, lat, lng``) are copied to the grid cells their box
    touches; races stay in one cell, so the join is an equi-join and the large
    side is not multiplied.  A crowded cell, even a single crowded spot, is cut
    into parts of about ``CELL_ROWS`` races, and its points go to each part.
    """
    high, wide = geo.box_degrees(F.col("lat"), radius_m)
    boxed = points.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select("*", high.alias("d_lat"), wide.alias("d_lng"))
    spread = boxed.select("*", _rows(F.col("lat") - F.col("d_lat"), F.col("lat") + F.col("d_lat")).alias("cy")).select(
        "*", _columns(F.col("lng") - F.col("d_lng"), F.col("lng") + F.col("d_lng")).alias("cx"))
    placed = races.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(
        "race_id", F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"),
        F.floor(F.col("lat") / CELL).alias("cy"), F.pmod(F.floor(F.col("lng") / CELL), F.lit(COLUMNS)).alias("cx"),
    )
    around = F.pmod(F.col("r_lng") - F.col("lng") + 180, F.lit(360.0)) - 180
    inside = (F.abs(F.col("r_lat") - F.col("lat")) <= F.col("d_lat")) & (F.abs(around) <= F.col("d_lng"))
    distance = geo.distance_m(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"))
    crowded = placed.groupBy("cy", "cx").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("parts")).filter("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    placed = placed.join(crowded, ["cy", "cx"], "left").withColumn("part", F.pmod(F.xxhash64("race_id"), parts).cast("int")).drop("parts")
    spread = spread.join(crowded, ["cy", "cx"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    found = spread.join(placed, ["cy", "cx", "part"]).filter(inside).select(*points.columns, "race_id", distance.alias("dist_m"))
    return found.filter(F.col("dist_m") <= radius_m)
