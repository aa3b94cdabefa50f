"""Presentation and scoring expressions over race columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceline import fixed_values as V
from paceline.functions.parse import lookup
from paceline.functions.text import is_blank, normalize_text


def number_text(value: Column) -> Column:
    """Shortest decimal text of a number: 10, 21.1, 42.195."""
    fixed = value.cast("decimal(20,6)").cast("string")
    return F.regexp_replace(fixed, r"\.?0+$", "")


def slug_base(name: Column, date: Column) -> Column:
    """Folded name joined by dashes, cut, then the year.  The cut may leave a dash at its end."""
    body = F.substring(F.replace(normalize_text(name), F.lit(" "), F.lit("-")), 1, V.SLUG_CHARS)
    return F.concat(body, F.lit("-"), F.substring(date.cast("string"), 1, 4))


def _filled(name: str, kind: str) -> Column:
    col = F.col(name)
    if kind == "text":
        return ~is_blank(col)
    if kind == "array":
        return F.coalesce(F.size(col) > 0, F.lit(False))
    return col.isNotNull()


def completeness(columns: dict[str, str]) -> Column:
    """Weighted fill rate as struct(score, level, label).

    ``columns`` maps each present field to ``text``, ``array`` or ``value``; an
    absent field counts as empty.
    """
    trail = F.coalesce(F.col("terrain") == "trail", F.lit(False))
    earned, total = F.lit(0), F.lit(0)
    for field, weight in V.COMPLETENESS_WEIGHTS:
        counts = trail if field == V.TRAIL_ONLY_FIELD else F.lit(True)
        total = total + F.when(counts, weight).otherwise(0)
        if field in columns:
            earned = earned + F.when(counts & _filled(field, columns[field]), weight).otherwise(0)
    score = F.floor(100 * earned / total + 0.5).cast("int")
    (high, high_name, high_label), (mid, mid_name, mid_label), (_, low_name, low_label) = V.COMPLETENESS_LEVELS
    return F.struct(
        score.alias("score"),
        F.when(score >= high, high_name).when(score >= mid, mid_name).otherwise(low_name).alias("level"),
        F.when(score >= high, high_label).when(score >= mid, mid_label).otherwise(low_label).alias("label"),
    )


RACE_KINDS = {
    "description": "text", "time_start": "text", "distances": "array", "price_from": "value",
    "website": "text", "registration_url": "text", "lat": "value", "elevation_gain": "value",
    "cover_url": "text", "organizer": "text", "capacity": "value",
}


def completeness_of(df) -> Column:
    """Completeness over whichever race fields ``df`` has."""
    return completeness({k: v for k, v in RACE_KINDS.items() if k in df.columns})


def distance_label(distances: Column) -> Column:
    shown = F.transform(
        distances,
        lambda d: F.when(d["km"] >= 1, F.concat(number_text(d["km"]), F.lit(" km"))).otherwise(
            F.concat(number_text(d["km"] * 1000), F.lit(" m"))
        ),
    )
    joined = F.array_join(shown, " / ")
    return F.when(joined != "", joined).otherwise(V.NOT_STATED)


def price_label(low: Column, high: Column) -> Column:
    return (
        F.when(low.isNotNull() & high.isNotNull(), F.concat(low.cast("string"), F.lit("–"), high.cast("string"), F.lit(" Kč")))
        .when(low == 0, V.FREE_LABEL)
        .when(low.isNotNull(), F.concat(F.lit("od "), low.cast("string"), F.lit(" Kč")))
        .otherwise(V.NOT_STATED)
    )


def terrain_label(terrain: Column) -> Column:
    return F.coalesce(lookup(V.TERRAIN_LABELS, terrain), terrain)


def location_label(city: Column, region: Column) -> Column:
    extra = F.coalesce((region != "") & (region != city), F.lit(False))
    return F.when(extra, F.concat(city, F.lit(", "), region)).otherwise(city)


def plural_label(count: Column, forms: tuple[str, str, str] = V.PLURAL_RACE) -> Column:
    one, few, many = forms
    return F.when(count == 1, one).when(count.between(2, 4), few).otherwise(many)


def encode_part(text: Column) -> Column:
    """Percent-encode one URL part; the marks ``! ' ( ) *`` stay as they are."""
    coded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(code), F.lit(mark))
    return coded


def share_url(base: str, slug: Column, user: Column) -> Column:
    return F.concat(F.lit(base + "/zavod/"), encode_part(slug), F.lit("?ref="), encode_part(user))


def date_short(date: Column) -> Column:
    """``6. 4. 2026``"""
    return F.concat_ws(". ", F.dayofmonth(date), F.month(date), F.year(date))


def date_long(date: Column, weekday: bool = True) -> Column:
    """``pondělí 6. dubna 2026``; without the weekday for an end date."""
    months = F.array(*[F.lit(m) for m in V.MONTHS_GENITIVE])
    text = F.concat(
        F.dayofmonth(date).cast("string"), F.lit(". "), F.get(months, F.month(date) - 1),
        F.lit(" "), F.year(date).cast("string"),
    )
    if not weekday:
        return text
    days = F.array(*[F.lit(d) for d in V.WEEKDAYS])
    return F.concat_ws(" ", F.get(days, F.weekday(date)), text)


def remap_terrain(terrain: Column) -> Column:
    """Retired value ``ultra`` becomes ``trail``."""
    return F.when(terrain == "ultra", "trail").otherwise(terrain)
