"""Constraint checks and summary counts over race tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline import fixed_values as V

def rows():
    return F.count(F.lit(1)).alias("n")


def stats_terrain(races: DataFrame) -> DataFrame:
    return races.groupBy("terrain").agg(rows()).orderBy(F.desc("n"), "terrain")


def stats_source(races: DataFrame) -> DataFrame:
    each = races.select(F.explode(F.split("source", ",")).alias("source"))
    return each.groupBy("source").agg(rows()).orderBy(F.desc("n"), "source")


def stats_coverage(races: DataFrame) -> DataFrame:
    return races.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("source").contains(",")).alias("multi_source"),
        F.count("official_url").alias("with_url"),
        F.count_if(F.col("official_url").isNull()).alias("without_url"),
        F.count("price_from").alias("with_price"),
    )


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Values of a unique column seen more than once; NULLs are not values."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(rows()).filter("n > 1")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per required column: how many rows lack it."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], columns, "column_name", "n_null")


def out_of_domain(df: DataFrame, domains: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row per column: rows whose value is not one of the allowed ones."""
    counted = df.agg(*[F.count_if(~F.col(c).isin(*v)).alias(c) for c, v in domains.items()])
    return counted.unpivot([], list(domains), "column_name", "n_bad")


RACE_DOMAINS = {
    "terrain": V.TERRAIN_ORDER, "status": V.RACE_STATUSES, "extraction_status": V.EXTRACTION_STATUSES,
}


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key has no parent row."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def city_centroid(races: DataFrame, norm) -> DataFrame:
    """Average coordinates per normalised city."""
    return (
        races.filter(F.col("lat").isNotNull()).groupBy(norm(F.col("city")).alias("norm_city"))
        .agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    )
