"""Batch integration: raw listings to one deduplicated race table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.operators import merge as M
from paceline.operators import normalize as N

RACE_COLUMNS = (
    "slug", "name", "description", "date_start", "time_start", "city", "region", "country",
    "distances", "terrain", "price_from", "price_to", "currency", "website", "official_url",
    "extraction_status", "source", "status", "organizer",
)


def merged_races(raw: DataFrame, **limits) -> DataFrame:
    """Merged races with their group columns, shared addresses still in place."""
    keyed, ids = M.resolve_items(N.accepted(N.normalize_items(raw)), **limits)
    return M.merge_groups(keyed, ids)


def integrate(raw: DataFrame, **limits) -> DataFrame:
    """Raw listings (22 texts, ``source``, ``ord``) to race rows ready to write."""
    return M.finish(merged_races(raw, **limits)).select(*RACE_COLUMNS)


def stage_counters(raw: DataFrame, races: DataFrame) -> DataFrame:
    """Rows per stage and reason; computed from the data, so retries cannot double-count."""
    items = N.normalize_items(raw)
    stages = items.groupBy(F.coalesce("reject_reason", F.lit("normalized")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    total = raw.agg(F.count(F.lit(1)).alias("n")).select(F.lit("raw").alias("stage"), "n")
    shared = (
        races.filter(F.col("official_url").isNotNull()).groupBy("official_url").count().filter("count > 1")
        .agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).select(F.lit("nullified_urls").alias("stage"), "n")
    )
    merged = races.agg(F.count(F.lit(1)).alias("n")).select(F.lit("merged").alias("stage"), "n")
    return total.unionByName(stages).unionByName(merged).unionByName(shared)
