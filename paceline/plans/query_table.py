"""Search for a table of queries: distinct filter sets meet the races through indexes, not one by one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline import fixed_values as V
from paceline.functions import text as T
from paceline.operators import filters as X
from paceline.operators.places import near_points, resolve_cities
from paceline.session import stage

FILTERS = {"terrain": "string", "region": "string", "month": "int", "km": "double", "city": "string", "proximity": "boolean",
           "search_text": "string"}
RACE = ("race_id", "slug", "name", "city", "region", "terrain", "date_start", "distances", "lat", "lng")
ANY = "*"
ANYWHERE = -1  # the place of filter sets without a city
BASE = ("place", "of_terrain", "of_month", "of_km")
HEADS = (1 / 64, 1 / 16, 1 / 4)  # shares of the races, by date, that may be enough for a list


def _numbered(df: DataFrame, name: str, label: str) -> DataFrame:
    return stage(df.withColumn(name, F.monotonically_increasing_id()), label)


def _text_scores(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``(search_text, names, score)``: the better score of name and city, above the threshold, for each distinct text.

    Texts and values meet on their trigrams; only pairs that share the least
    number a score above the threshold needs are scored.
    """
    def posted(df: DataFrame, column: str) -> DataFrame:
        return df.withColumn("grams", F.array_distinct(T.trigrams(F.col(column)))).withColumn("n", F.size("grams")).withColumn(
            "gram", F.explode("grams")).drop("grams")

    asked = posted(texts.withColumn("folded", T.normalize_czech(F.col("search_text"))), "folded")
    values = names.select(F.explode(F.array("folded_name", "folded_city")).alias("value")).filter("value IS NOT NULL").distinct()
    met = asked.join(posted(values, "value").drop("n"), "gram").groupBy("search_text", "folded", "n", "value").agg(F.count(F.lit(1)).alias("shared"))
    near = met.filter(F.col("shared") >= F.col("n") * V.FUZZY_THRESHOLD - 1e-6)
    # The costly part is dealt out to a stated number of tasks: the pairs are small and would be taken together again.
    # What is above the threshold is asked for afterwards, as a filter would be worked out before the pairs are dealt out.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = near.repartition(tasks, "search_text", "value").select(
        "search_text", "value", T.word_similarity(F.col("folded"), F.col("value")).alias("score"))
    scores = stage(scored, "scores").filter(F.col("score") > V.FUZZY_THRESHOLD)
    sides = [names.join(scores, F.col(c) == F.col("value")).select("search_text", "names", "score") for c in ("folded_name", "folded_city")]
    return sides[0].unionByName(sides[1]).groupBy("search_text", "names").agg(F.max("score").alias("score"))


def _by_mention(cities: DataFrame, races: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Races of which a column contains the city's text: both sides meet on its first three characters."""
    wanted = cities.select("place", F.lower(F.translate("city", "%_", "")).alias("wanted")).withColumn("gram", F.substring("wanted", 1, 3))
    texts = races.select(F.explode(F.array(*[F.lower(F.col(c)) for c in columns])).alias("text")).filter("text IS NOT NULL").distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)))
    grams = F.flatten(F.transform(starts, lambda i: F.array(*[F.col("text").substr(i, F.lit(n)) for n in (1, 2, 3)])))
    grams = F.array_distinct(F.concat(F.array(F.lit("")), grams))
    hits = texts.withColumn("gram", F.explode(grams)).join(wanted, "gram").filter(F.col("text").contains(F.col("wanted")))
    hits = stage(hits.select("place", "text").distinct(), "mentions")
    sides = [races.join(hits, F.lower(F.col(c)) == F.col("text")).select("place", "race_id", "row") for c in columns]
    once = reduce(DataFrame.unionByName, sides).groupBy("place", "race_id").agg(F.min("row").alias("row"))
    return once.select("place", "row", F.lit(1).cast("long").alias("times"))


def _by_place(centres: DataFrame, races: DataFrame) -> DataFrame:
    """Races around each city's point; unplaced ones, and all for a city without a point, by region, else by mention."""
    points = centres.filter("c_lat IS NOT NULL").select(F.col("place").alias("point_id"), F.col("c_lat").alias("lat"), F.col("c_lng").alias("lng"))
    close = near_points(points, races).select(F.col("point_id").alias("place"), "race_id").join(races.select("race_id", "row"), "race_id").select("place", "row")
    region = races.join(centres.select("place", "c_lat", "c_region"), F.col("region") == F.col("c_region")).filter(
        F.col("c_lat").isNull() | F.col("lat").isNull() | F.col("lng").isNull()).select("place", "row")
    around = close.unionByName(region).groupBy("place", "row").agg(F.count(F.lit(1)).alias("times"))
    return around.unionByName(_by_mention(centres.filter("c_lat IS NULL AND c_region IS NULL"), races, ("city", "region")))


def _with_marks(seen: DataFrame, names: DataFrame, listed: DataFrame, kms: DataFrame, as_of: str) -> DataFrame:
    """Each race with all the ways to find it: its names' number, places, terrains, months and wanted distances.

    ``first`` is false for further rows of a race id: those are no finds of
    their own for a text.  A month later than those that can be asked for is
    left out.  Rows lie together by names, so counts by names are small.
    """
    have = F.array_sort(F.array_distinct(F.transform("distances", lambda d: d["km"])))
    seen = seen.withColumn("have", have)
    fits = F.exists("have", lambda km: X.distance_fits(km, F.col("km")))
    fitting = seen.select("have").distinct().join(kms, fits).groupBy("have").agg(F.collect_list(F.col("km").cast("string")).alias("kms"))
    found = listed.groupBy("row").agg(F.collect_list(F.struct("place", "times")).alias("places"))
    ids = seen.groupBy("race_id").agg(F.min("row").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("race_id", "lead")
    ids = stage(ids, "repeated").withColumnRenamed("race_id", "again")
    step = seen.join(found, "row", "left").join(fitting, "have", "left").join(ids, F.col("race_id").eqNullSafe(F.col("again")), "left").join(
        names, T.normalize_czech(F.col("name")).eqNullSafe(F.col("folded_name")) & T.normalize_czech(F.col("city")).eqNullSafe(F.col("folded_city")))
    day = F.lit(as_of).cast("date")
    month = F.when(F.col("date_start") < F.add_months(F.trunc(day, "month"), 12), F.trunc("date_start", "month").cast("string"))
    everywhere = F.struct(F.lit(ANYWHERE).cast("long").alias("place"), F.lit(1).cast("long").alias("times"))

    def ways(own: Column) -> Column:
        return F.array_compact(F.array_distinct(F.array(F.lit(ANY), own)))

    step = step.select(
        "row", "race_id", "slug", "date_start", "region", "names", F.coalesce(F.col("row") == F.col("lead"), F.lit(True)).alias("first"),
        ways(F.col("terrain")).alias("terrains"), ways(month).alias("months"),
        F.concat(F.array(F.lit(ANY)), F.coalesce("kms", F.array().cast("array<string>"))).alias("kms"),
        F.concat(F.array(everywhere), F.coalesce("places", F.array().cast("array<struct<place:bigint,times:bigint>>"))).alias("places"))
    return stage(step.repartitionByRange("names", "row"), "marked")


def _each_way(marked: DataFrame) -> DataFrame:
    step = marked.withColumn("_p", F.explode("places")).withColumns({"place": F.col("_p.place"), "times": F.col("_p.times")}).drop("places", "_p")
    for many, one in (("terrains", "of_terrain"), ("months", "of_month"), ("kms", "of_km")):
        step = step.withColumn(one, F.explode(many)).drop(many)
    return step


def _meeting(marked: DataFrame, bases: DataFrame, *more: str) -> DataFrame:
    """Races with each base they pass: equal in place, terrain, month and distance, and of its region if it has one."""
    met = _each_way(marked).join(bases, [*BASE, *more])
    return met.filter(F.col("of_region").isNull() | (F.col("region") == F.col("of_region")))


def _head(counts: list[str], days: list, limit: int) -> Column:
    """First of the days up to which at least ``limit`` races were counted; NULL if none will do."""
    return F.coalesce(F.lit(None).cast("date"), *[F.when(F.col(n) >= limit, F.lit(d).cast("date")) for n, d in zip(counts, days, strict=True)])


def _until_cut() -> Column:
    return F.col("cut").isNull() | (F.col("date_start") <= F.col("cut"))


def search_by_queries(queries: DataFrame, races: DataFrame, dim: DataFrame, as_of: str, limit: int = V.SEARCH_LIMIT, digits: int | None = None) -> DataFrame:
    """The races that ``search_races`` finds for the filters of each row of ``queries``.

    ``queries`` has columns named like the filters (those missing are unset)
    next to its own.  Returns its rows with ``rank`` (from 1), ``race_id``,
    ``slug``, ``date_start`` and ``score`` (rounded to ``digits`` if given), at
    most ``limit`` for each; rows that find nothing are left out.

    Equal filter sets are searched once.  What is left of a filter set without
    its text is its base.  A race is listed under each place, terrain, month
    and distance that it answers to, so it meets the bases it passes by equal
    keys.  The first pass only counts: by base and names (a name and a city
    decide the score of any text), and among the earliest races.  The counts
    tell from which score on, and up to which day, a filter set's list is full;
    the second pass fetches and sorts only races that can be on a list.
    """
    rows = queries
    for name, kind in FILTERS.items():
        rows = rows.withColumn(name, F.col(name).cast(kind) if name in queries.columns else F.lit(None).cast(kind))
    rows = rows.withColumn("search_text", T.null_if_empty(F.col("search_text"))).withColumn(
        "proximity", F.when(F.col("city").isNotNull(), F.coalesce("proximity", F.lit(False))))
    key = F.to_json(F.struct(*FILTERS))
    rows = stage(rows.withColumn("filters", key), "queries")

    sets = stage(rows.select("filters", *FILTERS).distinct(), "sets")
    places = _numbered(sets.filter("city IS NOT NULL").select("city", "proximity").distinct(), "place", "places")
    near = places.filter("proximity").select("place", "city")
    centres = stage(resolve_cities(near, dim, races).select(
        "place", "city", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"), F.col("region").alias("c_region")), "centres")
    first = X.month_start_of(F.col("month"), F.lit(as_of).cast("date")).cast("string")
    sets = sets.join(places, ["city", "proximity"], "left").select(
        "filters", "search_text", F.coalesce("place", F.lit(ANYWHERE).cast("long")).alias("place"), F.coalesce("terrain", F.lit(ANY)).alias("of_terrain"),
        F.when(F.col("month").isNull(), ANY).otherwise(first).alias("of_month"), F.coalesce(F.col("km").cast("string"), F.lit(ANY)).alias("of_km"),
        F.col("region").alias("of_region"), F.col("km"))
    keys = [*BASE, "of_region"]
    texted = F.max(F.col("search_text").isNotNull()).alias("texted"), F.max(F.col("search_text").isNull()).alias("plain")
    bases = _numbered(sets.filter("of_month IS NOT NULL").groupBy(*keys).agg(*texted), "base", "bases")
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    numbered = stage(sets.alias("s").join(bases.alias("b"), same).select("s.filters", "s.search_text", "s.place", "b.base"), "numbered")
    kms = sets.select("km").filter("km IS NOT NULL").distinct()

    seen = _numbered(races.filter(X.visible(as_of)).select(*RACE), "row", "visible")
    names = seen.select(T.normalize_czech(F.col("name")).alias("folded_name"), T.normalize_czech(F.col("city")).alias("folded_city")).distinct()
    names = _numbered(names, "names", "names")
    mentioned = _by_mention(places.filter("NOT proximity"), seen, ("name", "city", "region"))
    marked = _with_marks(seen, names, _by_place(centres, seen).unionByName(mentioned), kms, as_of)
    scores = stage(_text_scores(numbered.select("search_text").filter("search_text IS NOT NULL").distinct(), names), "text-scores")

    # First pass: counts by base and names, of all races and of the earliest.
    days = marked.agg(F.percentile_approx(F.unix_date("date_start"), list(HEADS), 1000).alias("days")).select(
        F.transform("days", lambda d: F.date_from_unix_date(d)).alias("days")).first().days or []
    days = sorted(set(days))
    early = [F.col("date_start") <= F.lit(d) for d in days]
    one, own = [f"n{i}" for i in range(len(days))], [f"t{i}" for i in range(len(days))]
    is_first = F.col("texted") & F.col("first")
    counts = stage(_meeting(marked, bases).groupBy("base", "names").agg(
        F.count_if(is_first).alias("n"),
        *[F.count_if(is_first & e).alias(c) for c, e in zip(one, early, strict=True)],
        *[F.sum(F.when(e & F.col("plain"), F.col("times"))).alias(c) for c, e in zip(own, early, strict=True)]), "counts")

    # Without a text: the earliest races of each base.
    totals = counts.groupBy("base").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in own])
    plain = stage(bases.filter("plain").join(totals, "base").withColumn("cut", _head(own, days, limit)).select(*keys, "base", "cut"), "plain")
    by_date = Window.partitionBy("base").orderBy("date_start", "slug")
    found = _meeting(marked, plain).filter(_until_cut()).select(
        "base", "race_id", "slug", "date_start", F.explode(F.array_repeat(F.lit(0.0), F.col("times").cast("int"))).alias("score"))
    found = found.withColumn("rank", F.row_number().over(by_date)).filter(F.col("rank") <= limit)
    tops = numbered.filter("search_text IS NULL").select("filters", "base").join(found, "base").drop("base")

    # With a text: names from the best score down until there are enough races, and the earliest races of those.
    some = counts.filter("n > 0").select("base", "names", "n", _head(one, days, limit).alias("cut"))
    texts = numbered.filter("search_text IS NOT NULL")
    anywhere = F.col("place") == ANYWHERE
    pairs = texts.filter(~anywhere).join(some, "base").join(scores, ["search_text", "names"]).unionByName(
        texts.filter(anywhere).join(scores, "search_text").join(some, ["base", "names"]))
    best = Window.partitionBy("filters").orderBy(F.desc("score"))
    pairs = pairs.withColumn("up_to", F.sum("n").over(best)).withColumn(
        "least", F.max(F.when(F.col("up_to") >= limit, F.col("score"))).over(Window.partitionBy("filters")))
    pairs = stage(pairs.filter(F.col("least").isNull() | (F.col("score") >= F.col("least"))).select("filters", "base", "names", "score", "cut"), "pairs")
    wanted = stage(bases.select(*keys, "base").join(pairs.select("base", "names", "cut").distinct(), "base"), "wanted")
    heads = _meeting(marked.filter("first"), wanted, "names").filter(_until_cut()).select("base", "names", "race_id", "slug", "date_start")
    heads = heads.withColumn("nth", F.row_number().over(Window.partitionBy("base", "names").orderBy("date_start", "slug")))
    heads = stage(heads.filter(F.col("nth") <= limit).drop("nth"), "heads")
    ranked = pairs.drop("cut").join(heads, ["base", "names"]).select("filters", "race_id", "slug", "date_start", "score").withColumn(
        "rank", F.row_number().over(Window.partitionBy("filters").orderBy(F.desc("score"), "date_start", "slug")))
    tops = tops.unionByName(ranked.filter(F.col("rank") <= limit))

    # One row with its list for each filter set: queries meet that, and the list is laid out last.
    score = F.col("score") if digits is None else F.round("score", digits)
    lists = tops.groupBy("filters").agg(F.collect_list(F.struct("race_id", "slug", "date_start", score.alias("score"), "rank")).alias("found"))
    lists = stage(lists, "tops")
    own_columns = [c for c in queries.columns if c not in ("rank", "race_id", "slug", "date_start", "score")]
    hashed = F.xxhash64("filters").alias("_hash")  # texts of filters begin alike: a number sorts faster, the text decides
    met = rows.select(*[F.col(f"`{c}`") for c in own_columns], "filters", hashed).join(lists.select("*", hashed), ["_hash", "filters"])
    return met.select(*[F.col(f"`{c}`") for c in own_columns], F.explode("found").alias("_found")).select(
        *[F.col(f"`{c}`") for c in own_columns], "_found.*")
