"""Search: query parsing, filtered search, text ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline import fixed_values as V
from paceline.functions import geo
from paceline.functions import text as T
from paceline.operators import filters as X


# --- Query parsing -----------------------------------------------------------

def _any_of(patterns) -> str:
    """One pattern that matches where any of these does; whole words share their edges."""
    texts = [p for p, _ in patterns]
    if all(p.startswith(r"\b(?:") and p.endswith(r")\b") for p in texts):
        return r"\b(?:" + "|".join(p[5:-3] for p in texts) + r")\b"
    return "|".join(f"(?:{p})" for p in texts)


def _first_of(text: Column, patterns, matches=T.like) -> Column:
    """Value of the first pattern that matches; NULL if none does.

    Halves of the list are tried as one pattern each, so a text meets a few
    patterns and not all before the first that matches.
    """
    def among(part):
        half = len(part) // 2
        if not half:
            return F.lit(part[0][1])
        return F.when(matches(text, _any_of(part[:half])), among(part[:half])).otherwise(among(part[half:]))

    return F.when(matches(text, _any_of(patterns)), among(patterns))


def _strip_chosen(folded: Column, chosen: Column, patterns) -> Column:
    """Remove the first match of the pattern that gave ``chosen``."""
    cut = [F.when(chosen == value, T.drop_first_folded(folded, p)) for p, value in patterns]
    return F.coalesce(*cut, folded)


def parse_terrain(text: Column, small: bool = False) -> Column:
    return _first_of(text if small else T.small_letters(text), V.QUERY_TERRAINS, T.like_small)


def parse_month(text: Column, small: bool = False) -> Column:
    return _first_of(text if small else T.small_letters(text), V.QUERY_MONTHS, T.like_small)


def parse_city(normalized: Column) -> Column:
    return _first_of(normalized, V.QUERY_CITIES, T.like_folded)


def parse_km(normalized: Column) -> Column:
    """Distance by number or word; a word for ultra is handled by the caller."""
    number = F.regexp_extract(normalized, V.QUERY_KM_NUMBER, 1)
    return F.coalesce(T.null_if_empty(number).try_cast("int"), _first_of(normalized, V.QUERY_KM_WORDS, T.like_folded))


def parse_queries(queries: DataFrame, column: str = "q", fold_accents: bool = False) -> DataFrame:
    """Add display_query, terrain, city, month, km, proximity, search_text.

    Terrain and month are read from the text as typed, where a word edge is an
    ASCII one, so a month that ends in an accented letter is not seen;
    ``fold_accents`` reads them from the folded text instead.
    """
    step = queries.withColumn("display_query", F.substring(T.trim_blanks(F.col(column)), 1, V.MAX_QUERY_CHARS))
    step = step.withColumn("_n", T.normalize_text(F.col("display_query")))
    step = step.withColumn("_typed", F.col("_n") if fold_accents else T.small_letters(F.col("display_query")))
    step = step.select(
        "*",
        parse_terrain(F.col("_typed"), True).alias("terrain"),
        T.like_small(F.col("_typed"), V.QUERY_ULTRA).alias("_ultra"),
        parse_month(F.col("_typed"), True).alias("month"),
        parse_city(F.col("_n")).alias("city"),
        parse_km(F.col("_n")).alias("_km"),
        T.like_folded(F.col("_n"), V.QUERY_KM_NUMBER).alias("_by_number"),
        T.like_folded(F.col("_n"), V.QUERY_PROXIMITY).alias("_near"),
    )
    step = step.select(
        "*",
        F.coalesce("_km", F.when(F.col("_ultra"), V.ULTRA_KM)).alias("km"),
        F.when(F.col("city").isNotNull() & F.col("_near"), True).alias("proximity"),
    )
    # Consumed words leave the text one kind at a time, first match only.
    step = step.withColumn("_t", _strip_chosen(F.col("_n"), F.col("terrain"), V.QUERY_TERRAINS))
    step = step.withColumn("_t", F.when(F.col("_ultra"), T.drop_first_folded(F.col("_t"), V.QUERY_ULTRA)).otherwise(F.col("_t")))
    step = step.withColumn("_t", _strip_chosen(F.col("_t"), F.col("month"), V.QUERY_MONTHS))
    step = step.withColumn("_t", _strip_chosen(F.col("_t"), F.col("city"), V.QUERY_CITIES))
    step = step.withColumn("_t", F.when(F.col("proximity"), T.drop_first_folded(F.col("_t"), V.QUERY_PROXIMITY)).otherwise(F.col("_t")))
    number = V.QUERY_KM_NUMBER.replace("(", "(?:", 1)
    step = step.withColumn(
        "_t",
        F.when(F.col("_by_number"), T.drop_first_folded(F.col("_t"), number)).otherwise(
            _strip_chosen(F.col("_t"), F.col("_km"), V.QUERY_KM_WORDS)),
    )
    left = F.regexp_replace(F.regexp_replace(F.col("_t"), V.QUERY_FILLERS, " "), " +", " ")
    return step.withColumn("search_text", T.null_if_empty(F.trim(left))).select(
        *queries.columns, "display_query", "search_text", "terrain", "city", "month", "km", "proximity"
    )


def validate_filters(model_json: Column) -> Column:
    """A model's JSON answer as a struct; NULL unless it is a JSON object.

    A field of another JSON kind, or out of range, is absent (NULL): nothing is
    turned into the wanted kind, so ``"5"`` is no month and 55 no city.  A month
    that isn't whole is absent too.
    """
    def check(answer):
        def field(name, kinds, kind):
            part = F.try_variant_get(answer, f"$.{name}", "variant")
            return F.when(F.schema_of_variant(part).rlike(f"^({kinds})"), F.try_variant_get(answer, f"$.{name}", kind))

        number = "BIGINT|DECIMAL|DOUBLE|FLOAT"
        terrain, city = field("terrain", "STRING", "string"), field("city", "STRING", "string")
        month, km = field("month", number, "double"), field("km", number, "double")
        return F.struct(
            F.when(terrain.isin(*V.TERRAIN_LABELS), terrain).alias("terrain"),
            F.when(F.length(city) >= 2, city).alias("city"),
            F.when(month.between(1, 12) & (month == F.floor(month)), month).cast("int").alias("month"),
            F.when(km > 0, km).alias("km"),
            F.when(field("proximity", "BOOLEAN", "boolean"), True).alias("proximity"),
            F.coalesce(T.trim_blanks(field("searchText", "STRING", "string")), F.lit("")).alias("search_text"),
        )

    return T.let(F.try_parse_json(model_json), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), check(v)))


def choose_parse(parsed: DataFrame, model: str) -> DataFrame:
    """Filters to run: the model's when it answered, else the pattern parser's.

    The text filter is the model's text as is; the parser's text only if it
    recognised something, otherwise the whole query.  Zero kilometres are none.
    """
    answered = F.col(model).isNotNull()
    parsed = parsed.withColumn("km", F.nullif("km", F.lit(0)))
    structural = F.coalesce("terrain", F.col("month").cast("string"), F.col("km").cast("string"), "city").isNotNull()

    def pick(name, kind=None):
        ours = F.col(name) if kind is None else F.col(name).cast(kind)
        return F.when(answered, F.col(f"{model}.{name}")).otherwise(ours).alias(name)

    text = F.when(answered, F.col(f"{model}.search_text")).when(structural, F.coalesce("search_text", F.lit(""))).otherwise(F.col("display_query"))
    keep = [c for c in parsed.columns if c not in ("terrain", "city", "month", "km", "proximity", "search_text", model)]
    return parsed.select(*keep, pick("terrain"), pick("city"), pick("month"), pick("km", "double"), pick("proximity"), text.alias("search_text"))


# --- Filtered search ---------------------------------------------------------

def _near_city(found: DataFrame, races: DataFrame, city: str, dim: DataFrame) -> DataFrame:
    """Rows of ``found`` around a city.

    The city is looked up first.  One that the dimension lists gives plain
    numbers, so that the box around it is part of the scan's filter; only for
    others are point and region derived from the races, as scalar subqueries:
    one row each, never collected.
    """
    listed = dim.filter(F.col("name") == city).agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"), F.min("region").alias("region")).first()
    if None not in (listed.lat, listed.lng, listed.region):
        centre = found.select("*", *[F.lit(listed[n]).alias(f"_{n}") for n in ("lat", "lng", "region")])
    else:
        same = races.filter(T.normalize_czech(F.col("city")) == T.normalize_czech(F.lit(city)))
        derived = same.select(F.struct(
            F.avg("lat").alias("lat"), F.avg(F.when(F.col("lat").isNotNull(), F.col("lng"))).alias("lng"),
            F.min("region").alias("region"))).scalar()
        centre = found.select("*", derived.alias("_b")).select(
            *found.columns, *[F.coalesce(F.lit(listed[n]), F.col(f"_b.{n}")).alias(f"_{n}") for n in ("lat", "lng", "region")])
    lat, lng = F.col("_lat"), F.col("_lng")
    high, wide = geo.box_degrees(lat, V.RADIUS_M)
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    boxed = F.col("lat").between(lat - high, lat + high) & F.col("lng").between(lng - wide, lng + wide)
    close = boxed & (geo.distance_m(F.col("lat"), F.col("lng"), lat, lng) <= V.RADIUS_M)
    same_region = F.coalesce(F.col("region") == F.col("_region"), F.lit(False))
    near = (
        F.when(lat.isNotNull(), F.when(placed, close).otherwise(same_region))
        .when(F.col("_region").isNotNull(), same_region)
        .otherwise(X.mentions(city, "city", "region"))
    )
    return centre.filter(near).drop("_lat", "_lng", "_region")


def search_races(
    races: DataFrame, dim: DataFrame, as_of: str, *, terrain: str | None = None, region: str | None = None,
    month: int | None = None, km: float | None = None, city: str | None = None, proximity: bool = False,
    search_text: str | None = None, limit: int | None = V.SEARCH_LIMIT,
) -> DataFrame:
    """Visible races that pass every given filter, best text match first, then by date.

    ``slug`` breaks ties.  ``limit=None`` returns all of them.
    """
    tests = [X.visible(as_of)]
    if terrain is not None:
        tests.append(F.col("terrain") == terrain)
    if region is not None:
        tests.append(F.col("region") == region)
    if month is not None:
        tests.append(X.in_month(month, as_of))
    if km is not None:
        tests.append(X.has_distance(km))
    if city is not None and not proximity:
        tests.append(X.mentions(city, "name", "city", "region"))
    found = races.filter(reduce(lambda a, b: a & b, tests))
    if city is not None and proximity:
        found = _near_city(found, races, city, dim)
    if search_text:
        found = found.filter(X.fuzzy_possible(search_text)).withColumn("score", X.fuzzy_score(search_text)).filter(F.col("score") > V.FUZZY_THRESHOLD)
    else:
        found = found.withColumn("score", F.lit(0.0))
    if limit is None:
        return found
    return found.orderBy(F.desc("score"), "date_start", "slug").limit(limit)


def upcoming(races: DataFrame, as_of: str, limit: int = V.HOME_LIMIT) -> DataFrame:
    return races.filter(X.visible(as_of)).orderBy("date_start", "slug").limit(limit)


# --- Text ranking ------------------------------------------------------------

def rank_scores(races: DataFrame, query: Column) -> DataFrame:
    """Races with their text ``score`` for a query; unmatched ones are dropped.

    A query without usable words keeps every race at score 0.
    """
    step = races.select(
        "*",
        T.normalize_text(query).alias("_q"),
        T.normalize_text(F.col("name")).alias("_name"),
        T.normalize_text(F.concat_ws(" ", "name", "city", F.coalesce("region", F.lit("")))).alias("_text"),
    ).withColumn("_words", T.token_list(F.col("_q")))
    at = F.instr("_name", F.col("_q"))
    long_enough = F.length("_q") >= 3
    phrase = (
        F.when(long_enough & (at > 0), 10 + F.greatest(F.lit(0), 5 - F.floor((at - 1) / 3).cast("int")))
        .when(long_enough & F.col("_text").contains(F.col("_q")), 6)
        .otherwise(0)
    )

    def points(word):
        return F.when(F.array_contains(F.col("_in_name"), word), 4).when(F.array_contains(F.col("_in_text"), word), 2).otherwise(0)

    step = step.withColumn("_in_name", F.split("_name", " ")).withColumn("_in_text", F.split("_text", " "))
    step = step.withColumn("_points", F.transform("_words", points))
    complete = F.forall("_points", lambda p: p > 0)
    score = F.when(F.size("_words") == 0, 0).when(complete, phrase + F.aggregate("_points", F.lit(0), lambda a, p: a + p))
    scored = step.withColumn("score", score).filter((F.size("_words") == 0) | (F.col("score") > 0))
    return scored.select(*races.columns, "score")


def rank_by_query(races: DataFrame, query: str) -> DataFrame:
    """Matching races, best first, then by date; ``slug`` breaks ties."""
    return rank_scores(races, F.lit(query)).orderBy(F.desc("score"), "date_start", "slug")


def weighted_tokens(races: DataFrame) -> DataFrame:
    """Per race and word the highest field weight: name A, city B, description C."""
    def words(name, weight):
        tokens = F.split(F.lower(F.coalesce(F.col(name), F.lit(""))), r"[^\p{L}\p{N}]+")
        return F.transform(F.filter(tokens, lambda w: w != ""), lambda w: F.struct(w.alias("token"), F.lit(weight).alias("weight")))

    fields = F.concat(words("name", "A"), words("city", "B"), words("description", "C"))
    return (
        races.select("race_id", F.explode(fields).alias("t"))
        .groupBy("race_id", F.col("t.token").alias("token")).agg(F.min("t.weight").alias("weight"))
    )
