"""Raw listing rows to typed listing rows, with the reason for each rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions import parse as P
from paceline.functions.text import trim_blanks

_TRIMMED = (
    "district", "startPlace", "registrationPlace", "description", "contact", "facebook",
    "cup", "rewards", "edition",
)


def normalize_items(raw: DataFrame) -> DataFrame:
    """All rows, normalised, with ``reject_reason`` NULL on the good ones.

    Blank-able texts become ``''``; ``website``, ``startTime`` and fees stay NULL.
    """
    def text(name):
        return F.coalesce(F.col(name), F.lit(""))

    fields = raw.select(
        "ord",
        "source",
        F.col("url").alias("sourceUrl"),
        trim_blanks(text("title")).alias("title"),
        P.normalize_date(text("date")).alias("date"),
        P.normalize_city(text("city")).alias("city"),
        F.coalesce(P.normalize_region(text("region")), F.lit("")).alias("region"),
        P.is_foreign_region(text("region")).alias("_foreign"),
        P.parse_distances(text("distance")).alias("distances"),
        P.surface_to_terrain(text("surface")).alias("terrain"),
        P.normalize_time(text("startTime")).alias("startTime"),
        P.normalize_website(text("website")).alias("website"),
        P.parse_fee(text("feePreRegistration")).alias("_pre"),
        P.parse_fee(text("feeOnSite")).alias("_site"),
        *[trim_blanks(text(c)).alias(c) for c in _TRIMMED],
    )
    low, high = P.price_bounds(F.col("_pre"), F.col("_site"))
    reason = F.when(F.col("date").isNull(), "bad_date").when(F.col("_foreign"), "foreign")
    return fields.select(
        "*", low.alias("priceFrom"), high.alias("priceTo"), reason.alias("reject_reason")
    ).drop("_pre", "_site", "_foreign")


def accepted(items: DataFrame) -> DataFrame:
    return items.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(items: DataFrame) -> DataFrame:
    return items.filter(F.col("reject_reason").isNotNull())
