"""Predicates over race, report and interest rows.

Each takes plain Columns, so it can be pushed to the scan.  Optional filters
are built only for parameters that were given.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceline import fixed_values as V
from paceline.functions import text as T


def visible(as_of: str) -> Column:
    """Confirmed domestic races with extracted data, today or later."""
    return (
        (F.col("status") == "confirmed") & (F.col("country") == "CZ")
        & F.col("extraction_status").isin(*V.VISIBLE_EXTRACTION)
        & (F.col("date_start") >= F.lit(as_of).cast("date"))
    )


def month_bounds(month: int, as_of: str) -> tuple[dt.date, dt.date] | None:
    """First and last day of the month, next year once it has fully passed; None out of range."""
    if not 1 <= month <= 12:
        return None
    today = dt.date.fromisoformat(as_of)
    year = today.year
    last = dt.date(year, month, calendar.monthrange(year, month)[1])
    if last < today:
        year += 1
        last = dt.date(year, month, calendar.monthrange(year, month)[1])
    return dt.date(year, month, 1), last


def in_month(month: int, as_of: str) -> Column:
    bounds = month_bounds(month, as_of)
    if bounds is None:
        return F.lit(False)
    return F.col("date_start").between(*[F.lit(b) for b in bounds])


def month_start_of(month: Column, as_of: Column) -> Column:
    """Column form of ``month_bounds``: first day, NULL out of range."""
    this_year = F.make_date(F.year(as_of), month, F.lit(1))
    first = F.when(F.last_day(this_year) < as_of, F.add_months(this_year, 12)).otherwise(this_year)
    return F.when(month.between(1, 12), first)


def has_distance(km: float) -> Column:
    """Ultra: any distance from 50 km up; else any within 15 percent."""
    return F.exists("distances", lambda d: distance_fits(d["km"], F.lit(float(km))))


def distance_fits(have: Column, want: Column) -> Column:
    near = F.abs(have.cast("decimal(12,4)") - want.cast("decimal(12,4)")) <= want.cast("decimal(12,4)") * F.lit(str(V.KM_TOLERANCE)).cast("decimal(3,2)")
    return F.coalesce(F.when(want >= V.ULTRA_KM, have >= V.ULTRA_KM).otherwise(near), F.lit(False))


def safe_text(text: str) -> str:
    return text.replace("%", "").replace("_", "")


def mentions(city: str, *columns: str) -> Column:
    """Case-insensitive substring in any of the columns."""
    wanted = F.lower(F.lit(safe_text(city)))
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.lower(F.col(name)).contains(wanted), F.lit(False))
    return hit


def fuzzy_score(search_text: str) -> Column:
    wanted = T.normalize_czech(F.lit(search_text))
    return F.greatest(
        T.word_similarity(wanted, T.normalize_czech(F.col("name"))),
        T.word_similarity(wanted, T.normalize_czech(F.col("city"))),
    )


def fuzzy_possible(search_text: str, least: float = V.FUZZY_THRESHOLD) -> Column:
    """A cheap test that every row with ``fuzzy_score`` above ``least`` passes."""
    wanted = T.normalize_czech(F.lit(search_text))
    name, city = (T.may_be_similar(wanted, T.normalize_czech(F.col(c)), least) for c in ("name", "city"))
    return name | city


def report_valid() -> Column:
    """At least one reason or a message."""
    return (F.size("reasons") > 0) | F.coalesce(F.length("message") > 0, F.lit(False))


def valid_url(url: Column) -> Column:
    """Parses as an absolute address whose scheme starts with http."""
    clean = T.trim_blanks(url)
    return F.coalesce(
        F.lower(F.try_parse_url(clean, F.lit("PROTOCOL"))).startswith("http")
        & (F.try_parse_url(clean, F.lit("HOST")) != ""),
        F.lit(False),
    )


def needs_extraction() -> Column:
    return F.col("extraction_status").isin(*V.QUEUED_EXTRACTION)


def open_report() -> Column:
    return ~F.col("resolved")


def owned_by(user: int | str, column: str = "user_id") -> Column:
    return F.coalesce(F.col(column) == F.lit(user), F.lit(False))
