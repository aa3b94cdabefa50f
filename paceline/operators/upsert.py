"""Keyed upsert of merged races into a race table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.operators.ordering import spread_null_key


def derive_location(races: DataFrame) -> DataFrame:
    """Add the point when both coordinates are there."""
    both = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return races.withColumn("location", F.when(both, F.struct("lat", "lng")))


def judge_batch(table: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch`` with ``reason``: why a row can't be written, NULL if it can.

    Slug and address are each unique in the table.  Rows that repeat one inside
    the batch all fail; so does a row with an address whose slug another stored
    row holds.
    """
    repeats = lambda key: batch.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1")
    bad_slug = repeats("slug").select("slug", F.lit(True).alias("_s"))
    bad_url = repeats("official_url").select(F.col("official_url").alias("_key"), F.lit(True).alias("_u"))
    held = table.groupBy("slug").agg(F.max(F.struct(F.coalesce("official_url", F.lit("")).alias("by"))).alias("_held"))
    marked = (
        batch.join(bad_slug, "slug", "left").join(held, "slug", "left")
        .withColumn("_key", spread_null_key(F.col("official_url"), F.col("slug")))
        .join(bad_url, "_key", "left")
    )
    taken = F.col("official_url").isNotNull() & F.col("_held").isNotNull() & (F.col("_held.by") != F.col("official_url"))
    reason = F.when(F.col("_s"), "slug repeated").when(F.col("_u"), "address repeated").when(taken, "slug taken")
    return marked.select(*batch.columns, reason.alias("reason"))


def _merge(table: DataFrame, batch: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Full outer merge on one key; NULL keys of the table match nothing.

    Columns of the batch overwrite, even with NULL; columns it lacks keep their
    value.  Inserts get both times, updates only ``updated_at``.
    """
    new = batch.select(F.col(key).alias("_key"), F.struct(*batch.columns).alias("_new"))
    old = table.select(spread_null_key(F.col(key), F.col("slug")).alias("_key"), F.struct(*table.columns).alias("_old"))
    both = old.join(new, "_key", "full_outer")
    is_new, had = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    out = []
    for name in table.columns:
        value = F.col(f"_old.{name}")
        if name == "created_at":
            value = F.when(had, value).otherwise(as_of)
        elif name == "updated_at":
            value = F.when(is_new, as_of).otherwise(value)
        elif name in batch.columns:
            value = F.when(is_new, F.col(f"_new.{name}")).otherwise(value)
        out.append(value.alias(name))
    return both.select(*out)


def upsert_races(table: DataFrame, batch: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Table after the batch, and the batch's rejected rows with their reason.

    Rows are matched by ``official_url`` where given, else by ``slug``.
    """
    now, judged = F.lit(as_of).cast("timestamp"), judge_batch(table, batch)
    good = judged.filter("reason IS NULL").drop("reason")
    with_url = good.filter(F.col("official_url").isNotNull())
    without = good.filter(F.col("official_url").isNull())
    after = _merge(_merge(table, with_url, "official_url", now), without, "slug", now)
    return after, judged.filter("reason IS NOT NULL")
