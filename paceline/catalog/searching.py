"""Queries over race rows: filters, places, search, labels, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceline import fixed_values as V
from paceline.catalog import duck as D
from paceline.catalog import tables as T
from paceline.catalog.registry import query
from paceline.functions import labels as L
from paceline.functions import text as X
from paceline.operators import filters as P
from paceline.operators import places
from paceline.operators import quality as Q
from paceline.plans import search as S
from paceline.plans.query_table import search_by_queries
from paceline.sources.cities import city_dim

AS_OF = T.AS_OF
RACES = f"""races AS (SELECT *, list_filter([{{'label': 'hlavní', 'km': km1}}, {{'label': 'krátká', 'km': km2}}], lambda d: d.km IS NOT NULL) AS distances
  FROM ({T.text(T.RACES)}))"""
CITY = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, '{r}')" for n, a, b, r in V.CITY_COORDINATES) + ") v(name, lat, lng, region))"
VISIBLE = (f"(status = 'confirmed' AND country = 'CZ' AND extraction_status IN ('extracted', 'complete') AND date_start >= DATE '{AS_OF}')")


def _filter(name, make, duck):
    """Register a predicate: ids of the rows that pass."""
    def run(spark, sf):
        return T.races(spark, sf).filter(make()).select("race_id")

    query(name, f"WITH {RACES} SELECT race_id FROM races WHERE {duck}")(run)


def _label(name, make, duck):
    def run(spark, sf):
        return T.races(spark, sf).select("race_id", make().alias("value"))

    query(name, f"WITH {RACES} SELECT race_id, {duck} AS value FROM races")(run)


def _mentions(city, *cols):
    return "(" + " OR ".join(f"coalesce(contains(lower({c}), lower('{city}')), false)" for c in cols) + ")"


# --- Filters -----------------------------------------------------------------

_filter("filter_visible", lambda: P.visible(AS_OF), VISIBLE)
_filter("filter_terrain", lambda: F.col("terrain") == "trail", "terrain = 'trail'")
_filter("filter_region", lambda: F.col("region") == "Jihomoravský", "region = 'Jihomoravský'")
_filter("filter_month", lambda: P.in_month(3, AS_OF), "date_start BETWEEN DATE '1999-03-01' AND DATE '1999-03-31'")
_filter("filter_distance", lambda: P.has_distance(21), "len(list_filter(distances, lambda d: abs(d.km::DECIMAL(12,4) - 21) <= 3.15)) > 0")
_filter("filter_ultra", lambda: P.has_distance(50), "len(list_filter(distances, lambda d: d.km >= 50)) > 0")
_filter("filter_city", lambda: P.mentions("br%no_", "name", "city", "region"), _mentions("brno", "name", "city", "region"))
_filter("work_queue", lambda: P.needs_extraction(), "extraction_status IN ('pending', 'failed')")
_filter("filter_valid_url", lambda: P.valid_url(F.coalesce("website", F.lit("bez adresy"))), "website IS NOT NULL")


def duck_similarity(text, query_text):
    """Best run similarity over all runs of the text's trigrams."""
    def grams(x):
        words = f"list_filter(regexp_split_to_array({x}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
        return f"flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"

    q = f"list_distinct({grams(query_text)})"
    return q, grams(text)


def _sim_sql(select, where, text_q):
    """Similarity of a constant text with name and city, run by run."""
    q, g = duck_similarity("t", f"'{text_q}'")
    return f"""WITH {RACES}, texts AS (SELECT DISTINCT {D.czech('name')} AS t FROM races UNION SELECT DISTINCT {D.czech('city')} FROM races),
grams AS (SELECT t, {q} AS q, {g} AS g FROM texts),
starts AS (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM grams WHERE len(g) > 0),
runs AS (SELECT *, unnest(range(i, len(g) + 1)) AS j FROM starts),
sim AS (SELECT t, max(len(list_intersect(q, list_distinct(g[i:j])))::DOUBLE / (len(q) + len(list_distinct(g[i:j])) - len(list_intersect(q, list_distinct(g[i:j]))))) AS s FROM runs GROUP BY t),
scored AS (SELECT r.*, greatest(coalesce(a.s, 0), coalesce(b.s, 0)) AS score FROM races r
  LEFT JOIN sim a ON a.t = {D.czech('r.name')} LEFT JOIN sim b ON b.t = {D.czech('r.city')})
SELECT {select} FROM scored WHERE {where}"""


@query("word_similarity", _sim_sql("race_id, round(score, 5) AS score", "true", "maraton prah"))
def word_similarity(spark, sf):
    return T.races(spark, sf).select("race_id", F.round(P.fuzzy_score("Maraton Práh"), 5).alias("score"))


@query("filter_fuzzy", _sim_sql("race_id, round(score, 5) AS score", "score > 0.15", "jizerska 50"))
def filter_fuzzy(spark, sf):
    races = T.races(spark, sf).filter(P.fuzzy_possible("Jizerská 50")).withColumn("score", P.fuzzy_score("Jizerská 50"))
    return races.filter(F.col("score") > V.FUZZY_THRESHOLD).select("race_id", F.round("score", 5).alias("score"))


@query("month_bounds", f"""WITH {RACES} SELECT race_id, CAST(CASE WHEN last_day(make_date(1998, m, 1)) < DATE '{AS_OF}'
  THEN make_date(1999, m, 1) ELSE make_date(1998, m, 1) END AS VARCHAR) AS first_day
  FROM (SELECT race_id, CASE WHEN race_id % 14 BETWEEN 1 AND 12 THEN CAST(race_id % 14 AS INTEGER) END AS m FROM races)""")
def month_bounds(spark, sf):
    month = (F.col("race_id") % 14).cast("int")
    valid = F.when(month.between(1, 12), month)
    first = P.month_start_of(valid, F.lit(AS_OF).cast("date"))
    return T.races(spark, sf).select("race_id", first.cast("string").alias("first_day"))


# --- Places ------------------------------------------------------------------

@query("city_dim", f"WITH {RACES}, {CITY} SELECT name, round(lat, 4) AS lat, round(lng, 4) AS lng, region FROM dim UNION ALL "
       "SELECT city, min(round(lat, 4)), min(round(lng, 4)), 'odvozeno' FROM races WHERE lat IS NOT NULL AND city NOT IN (SELECT name FROM dim) GROUP BY city")
def city_dimension(spark, sf):
    races = T.races(spark, sf).filter("lat IS NOT NULL").groupBy(F.col("city").alias("name")).agg(
        F.min("lat").alias("lat"), F.min("lng").alias("lng")).withColumn("region", F.lit("odvozeno"))
    return city_dim(spark, races).select("name", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"), "region")


@query("derive_location", f"WITH {RACES} SELECT race_id, CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN 1 ELSE 0 END AS has_location, round(lat, 4) AS lat FROM races")
def derive_location(spark, sf):
    from paceline.operators.upsert import derive_location as derive

    located = derive(T.races(spark, sf))
    return located.select("race_id", F.col("location").isNotNull().cast("int").alias("has_location"), F.round("location.lat", 4).alias("lat"))


_NAMED = f"""named AS (SELECT DISTINCT city FROM races),
stats AS (SELECT {D.czech('city')} AS nc, avg(lat) AS a, avg(lng) FILTER (WHERE lat IS NOT NULL) AS b, min(region) AS r FROM races GROUP BY 1),
resolved AS (SELECT n.city, coalesce(d.lat, s.a) AS lat, CASE WHEN d.lat IS NOT NULL THEN d.lng ELSE s.b END AS lng, coalesce(d.region, s.r) AS region
  FROM named n LEFT JOIN dim d ON d.name = n.city LEFT JOIN stats s ON s.nc = {D.czech('n.city')})"""


def _lambert(a, b, c, d):
    """The same distance formula in SQL, from latitude/longitude pairs."""
    f, r = "(1.0::DOUBLE / 298.257223563::DOUBLE)", "6378137.0::DOUBLE"
    b1, b2 = f"atan((1 - {f}) * tan(radians({a})))", f"atan((1 - {f}) * tan(radians({c})))"
    h = f"least(pow(sin(({b2} - {b1}) / 2), 2) + cos({b1}) * cos({b2}) * pow(sin(radians({d} - {b}) / 2), 2), 1.0)"
    s, p, q = f"(2 * asin(sqrt({h})))", f"(({b1} + {b2}) / 2)", f"(({b2} - {b1}) / 2)"
    x = f"(({s} - sin({s})) * pow(sin({p}) * cos({q}), 2) / pow(cos({s} / 2), 2))"
    y = f"(({s} + sin({s})) * pow(cos({p}) * sin({q}), 2) / pow(sin({s} / 2), 2))"
    return f"(CASE WHEN {s} = 0 THEN 0.0 ELSE {r} * ({s} - ({f} / 2) * ({x} + {y})) END)"


@query("city_resolve", f"WITH {RACES}, {CITY}, {_NAMED} SELECT city, round(lat, 5) AS lat, round(lng, 5) AS lng, region FROM resolved")
def city_resolve(spark, sf):
    races = T.races(spark, sf)
    found = places.resolve_cities(races.select("city").distinct(), city_dim(spark), races)
    return found.select("city", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"), "region")


@query("proximity_join", f"""WITH {RACES}, {CITY}, {_NAMED} SELECT point_id, race_id, round(dist / 1000, 3) AS dist_km FROM (
  SELECT p.city AS point_id, r.race_id, {_lambert('p.lat', 'p.lng', 'r.lat', 'r.lng')} AS dist FROM resolved p JOIN races r ON r.lat IS NOT NULL) WHERE dist <= 40000""")
def proximity_join(spark, sf):
    races = T.races(spark, sf)
    points = places.resolve_cities(races.select(F.col("city").alias("point_id")).distinct(), city_dim(spark), races, "point_id")
    near = places.near_points(points.select("point_id", "lat", "lng"), races)
    return near.select("point_id", "race_id", F.round(F.col("dist_m") / 1000, 3).alias("dist_km"))


@query("city_centroid", f"WITH {RACES} SELECT {D.norm('city')} AS norm_city, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM races WHERE lat IS NOT NULL GROUP BY 1")
def city_centroid(spark, sf):
    return Q.city_centroid(T.races(spark, sf), X.normalize_text).select("norm_city", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


# --- Search ------------------------------------------------------------------

@query("race_by_slug", f"WITH {RACES} SELECT race_id, slug, name FROM races WHERE slug = 'zavod-7'")
def race_by_slug(spark, sf):
    """At most one row: the slug is unique."""
    return T.races(spark, sf).filter(F.col("slug") == "zavod-7").limit(1).select("race_id", "slug", "name")


@query("upcoming_topk", f"WITH {RACES} SELECT race_id, slug, CAST(date_start AS VARCHAR) AS day FROM races WHERE {VISIBLE} ORDER BY date_start, slug LIMIT 6")
def upcoming_topk(spark, sf):
    return S.upcoming(T.races(spark, sf), AS_OF).select("race_id", "slug", F.col("date_start").cast("string").alias("day"))


def _search(name, sql_where, with_cities=False, **params):
    extra = f", {CITY}" if with_cities else ""

    def run(spark, sf):
        found = S.search_races(T.races(spark, sf), city_dim(spark), AS_OF, **params)
        return found.select("race_id", "slug", F.col("date_start").cast("string").alias("day"))

    query(name, f"WITH {RACES}{extra} SELECT race_id, slug, CAST(date_start AS VARCHAR) AS day FROM races WHERE {VISIBLE} AND {sql_where} "
          "ORDER BY date_start, slug LIMIT 100")(run)


_search("search_races", "terrain = 'trail' AND region = 'Jihomoravský' AND len(list_filter(distances, lambda d: abs(d.km::DECIMAL(12,4) - 10) <= 1.5)) > 0",
        terrain="trail", region="Jihomoravský", km=10)
_search("search_city_month", f"date_start BETWEEN DATE '1998-09-01' AND DATE '1998-09-30' AND {_mentions('praha', 'name', 'city', 'region')}", city="Praha", month=9)
_search("search_proximity", f"""(CASE WHEN lat IS NOT NULL THEN {_lambert('lat', 'lng', "(SELECT lat FROM dim WHERE name = 'Brno')", "(SELECT lng FROM dim WHERE name = 'Brno')")} <= 40000
  ELSE coalesce(region = 'Jihomoravský', false) END)""", with_cities=True, city="Brno", proximity=True)
_search("search_proximity_derived", f"""(CASE WHEN lat IS NOT NULL THEN {_lambert('lat', 'lng', "(SELECT avg(lat) FROM races WHERE city = 'Vesec')", "(SELECT avg(lng) FROM races WHERE city = 'Vesec' AND lat IS NOT NULL)")} <= 40000
  ELSE coalesce(region = 'Liberecký', false) END)""", city="Vesec", proximity=True)
_search("search_proximity_text", _mentions("moravský", "city", "region"), city="moravský", proximity=True)


@query("search_fuzzy", _sim_sql("race_id, slug, round(score, 5) AS score", f"score > 0.15 AND {VISIBLE} ORDER BY scored.score DESC, date_start, slug LIMIT 100", "nocni trail brna"))
def search_fuzzy(spark, sf):
    found = S.search_races(T.races(spark, sf), city_dim(spark), AS_OF, search_text="Noční trail Brna")
    return found.select("race_id", "slug", F.round("score", 5).alias("score"))


@query("rank_by_query", f"""WITH {RACES}, t AS (SELECT race_id, {D.norm('name')} AS n, {D.norm("concat_ws(' ', name, city, coalesce(region, ''))")} AS x FROM races),
w AS (SELECT race_id, n, x, unnest(['maraton', 'praha']) AS w FROM t),
p AS (SELECT race_id, sum(CASE WHEN list_contains(string_split(n, ' '), w) THEN 4 WHEN list_contains(string_split(x, ' '), w) THEN 2 ELSE 0 END) AS pts,
  min(CASE WHEN list_contains(string_split(x, ' '), w) THEN 1 ELSE 0 END) AS whole FROM w GROUP BY 1)
SELECT race_id, CAST(pts + CASE WHEN instr(n, 'maraton praha') > 0 THEN 10 + greatest(0, 5 - (instr(n, 'maraton praha') - 1) // 3)
  WHEN contains(x, 'maraton praha') THEN 6 ELSE 0 END AS BIGINT) AS score FROM t JOIN p USING (race_id) WHERE whole = 1""")
def rank_by_query(spark, sf):
    return S.rank_by_query(T.races(spark, sf), "Maraton Praha").select("race_id", F.col("score").cast("bigint").alias("score"))


@query("word_match", f"WITH {RACES} SELECT race_id, CAST(list_contains(string_split({D.norm('name')}, ' '), 'maraton') AS INTEGER) AS value FROM races")
def word_match(spark, sf):
    return T.races(spark, sf).select("race_id", X.has_word(X.normalize_text(F.col("name")), F.lit("maraton")).cast("int").alias("value"))


@query("weighted_fts", f"""WITH {RACES}, t AS (
  SELECT race_id, unnest(regexp_split_to_array(lower(name), '[^\\p{{L}}\\p{{N}}]+')) AS token, 'A' AS w FROM races
  UNION ALL SELECT race_id, unnest(regexp_split_to_array(lower(city), '[^\\p{{L}}\\p{{N}}]+')), 'B' FROM races
  UNION ALL SELECT race_id, unnest(regexp_split_to_array(lower(description), '[^\\p{{L}}\\p{{N}}]+')), 'C' FROM races)
SELECT race_id, token, min(w) AS weight FROM t WHERE token <> '' GROUP BY 1, 2""")
def weighted_fts(spark, sf):
    return S.weighted_tokens(T.races(spark, sf))


# --- Query texts -------------------------------------------------------------

def _first(x, patterns, text=True):
    arms = " ".join(f"WHEN regexp_matches({x}, '(?i){p}') THEN " + (f"'{v}'" if text else str(v)) for p, v in patterns)
    return f"(CASE {arms} END)"


def _strip(x, chosen, patterns, text=True):
    arms = " ".join(f"WHEN {chosen} = " + (f"'{v}'" if text else str(v)) + f" THEN regexp_replace({x}, '(?i){p}', ' ')" for p, v in patterns)
    return f"(CASE {arms} ELSE {x} END)"


def _parse_sql(folded):
    typed = "n" if folded else "display_query"
    near = V.QUERY_PROXIMITY
    return f"""WITH q0 AS (SELECT query_id, left(trim(q), 200) AS display_query, {D.norm('left(trim(q), 200)')} AS n FROM ({T.text(T.SEARCHES)})),
q1 AS (SELECT *, {_first(typed, V.QUERY_TERRAINS)} AS terrain, regexp_matches({typed}, '(?i)\\bultra\\b') AS ultra,
  {_first(typed, V.QUERY_MONTHS, False)} AS month, {_first('n', V.QUERY_CITIES)} AS city,
  coalesce(TRY_CAST(NULLIF(regexp_extract(n, '{V.QUERY_KM_NUMBER}', 1), '') AS INTEGER), {_first('n', V.QUERY_KM_WORDS, False)}) AS km0,
  regexp_matches(n, '{V.QUERY_KM_NUMBER}') AS numbered, regexp_matches(n, '{near}') AS near FROM q0),
q2 AS (SELECT *, coalesce(km0, CASE WHEN ultra THEN 50 END) AS km, CASE WHEN city IS NOT NULL AND near THEN 1 END AS proximity,
  {_strip('n', 'terrain', V.QUERY_TERRAINS)} AS t1 FROM q1),
q3 AS (SELECT *, CASE WHEN ultra THEN regexp_replace(t1, '\\bultra\\b', ' ') ELSE t1 END AS t2 FROM q2),
q4 AS (SELECT *, {_strip('t2', 'month', V.QUERY_MONTHS, False)} AS t3 FROM q3),
q5 AS (SELECT *, {_strip('t3', 'city', V.QUERY_CITIES)} AS t4 FROM q4),
q6 AS (SELECT *, CASE WHEN proximity = 1 THEN regexp_replace(t4, '{near}', ' ') ELSE t4 END AS t5 FROM q5),
q7 AS (SELECT *, CASE WHEN numbered THEN regexp_replace(t5, '{V.QUERY_KM_NUMBER}', ' ') ELSE {_strip('t5', 'km0', V.QUERY_KM_WORDS, False)} END AS t6 FROM q6),
parsed AS (SELECT query_id, display_query, NULLIF(trim(regexp_replace(regexp_replace(t6, '{V.QUERY_FILLERS}', ' ', 'g'), ' +', ' ', 'g')), '') AS search_text,
  terrain, city, month, km, proximity FROM q7)"""


PARSED = _parse_sql(False)


def _parsed(spark, sf, **options):
    return S.parse_queries(T.searches(spark, sf), **options).withColumn("proximity", F.col("proximity").cast("int"))


@query("parse_query", PARSED + " SELECT * FROM parsed")
def parse_query(spark, sf):
    return _parsed(spark, sf).drop("q")


@query("parse_query_folded", _parse_sql(True) + " SELECT * FROM parsed")
def parse_query_folded(spark, sf):
    return _parsed(spark, sf, fold_accents=True).drop("q")


def _part(name, column):
    query(name, PARSED + f" SELECT query_id, {column} AS value FROM parsed")(
        lambda spark, sf: _parsed(spark, sf).select("query_id", F.col(column).alias("value")))


_part("parse_terrain", "terrain")
_part("parse_month", "month")
_part("parse_city", "city")
_part("parse_proximity", "proximity")
_part("parse_km", "km")
_part("leftover_text", "search_text")

# A model's answer per query text, as JSON; every third query has none, some are broken, not an object or of wrong kinds.
_ANSWER = ("CASE WHEN query_id % 3 > 0 THEN CASE query_id % 11 WHEN 3 THEN 'not json' WHEN 4 THEN '[]' WHEN 5 THEN 'null' WHEN 6 THEN '' "
           "WHEN 7 THEN '{\"terrain\": 1, \"city\": 55, \"month\": \"5\", \"km\": \"21\", \"proximity\": 1, \"searchText\": [1]}' "
           "WHEN 8 THEN '{\"month\": 5.5, \"km\": 0, \"city\": null}' ELSE "
           "'{\"terrain\": \"' || CASE query_id % 5 WHEN 0 THEN 'road' WHEN 1 THEN 'ultra' ELSE 'mixed' END || "
           "'\", \"city\": \"' || CASE WHEN query_id % 4 = 0 THEN 'B' ELSE 'Brno' END || '\", \"month\": ' || CAST(query_id % 14 AS STRING) || "
           "', \"km\": ' || CAST(query_id % 30 AS STRING) || '.5, \"proximity\": ' || CASE WHEN query_id % 2 = 0 THEN 'true' ELSE 'false' END || "
           "', \"searchText\": \" text ' || CAST(query_id % 7 AS STRING) || ' \"}' END END")
_ANSWERED = "(query_id % 3 > 0 AND query_id % 11 NOT IN (3, 4, 5, 6))"
_FULL = "query_id % 11 NOT IN (7, 8)"
_CHECKED = (f"CASE WHEN {_FULL} AND query_id % 5 <> 1 THEN CASE query_id % 5 WHEN 0 THEN 'road' ELSE 'mixed' END END AS terrain, "
            f"CASE WHEN {_FULL} AND query_id % 4 > 0 THEN 'Brno' END AS city, "
            f"CASE WHEN {_FULL} AND query_id % 14 BETWEEN 1 AND 12 THEN CAST(query_id % 14 AS INTEGER) END AS month, "
            f"CASE WHEN {_FULL} THEN CAST(query_id % 30 AS DOUBLE) + 0.5 END AS km, "
            f"CASE WHEN {_FULL} AND query_id % 2 = 0 THEN 1 END AS proximity, "
            f"CASE WHEN {_FULL} THEN 'text ' || CAST(query_id % 7 AS STRING) ELSE '' END AS search_text")


def _answers(spark, sf):
    return _parsed(spark, sf).withColumn("proximity", F.col("proximity") == 1).withColumn("model", S.validate_filters(F.expr(_ANSWER)))


@query("validate_filters", f"WITH q AS ({T.text(T.SEARCHES)}), m AS (SELECT query_id, {_CHECKED} FROM q) SELECT query_id, "
       + ", ".join(f"CASE WHEN {_ANSWERED} THEN {c} END AS {c}" for c in ("terrain", "city", "month", "km", "proximity", "search_text")) + " FROM m")
def validate_filters(spark, sf):
    rows = T.searches(spark, sf).select("query_id", S.validate_filters(F.expr(_ANSWER)).alias("m"))
    return rows.select("query_id", "m.terrain", "m.city", "m.month", "m.km", F.col("m.proximity").cast("int").alias("proximity"), "m.search_text")


@query("choose_parse", PARSED + f""", model AS (SELECT query_id, {_CHECKED} FROM q0)
SELECT p.query_id, p.display_query, CASE WHEN a THEN m.terrain ELSE p.terrain END AS terrain, CASE WHEN a THEN m.city ELSE p.city END AS city,
  CASE WHEN a THEN m.month ELSE p.month END AS month, CASE WHEN a THEN m.km ELSE CAST(NULLIF(p.km, 0) AS DOUBLE) END AS km,
  CASE WHEN a THEN m.proximity ELSE p.proximity END AS proximity,
  CASE WHEN a THEN m.search_text WHEN p.terrain IS NOT NULL OR p.month IS NOT NULL OR NULLIF(p.km, 0) IS NOT NULL OR p.city IS NOT NULL THEN coalesce(p.search_text, '') ELSE p.display_query END AS search_text
FROM (SELECT *, {_ANSWERED} AS a FROM parsed) p JOIN model m USING (query_id)""")
def choose_parse(spark, sf):
    return S.choose_parse(_answers(spark, sf).drop("q"), "model").withColumn("proximity", F.col("proximity").cast("int"))


def _queries_sql() -> str:
    """Every query against every visible race; similarities are those of distinct texts and distinct names."""
    q, g = duck_similarity("t", "folded")
    safe = "replace(replace(f.city, '%', ''), '_', '')"
    mention = lambda *cols: "(" + " OR ".join(f"coalesce(contains(lower(r.{c}), lower({safe})), false)" for c in cols) + ")"
    same = "coalesce(r.region = c.region, false)"
    near = (f"CASE WHEN c.lat IS NOT NULL THEN CASE WHEN r.lat IS NOT NULL AND r.lng IS NOT NULL THEN {_lambert('r.lat', 'r.lng', 'c.lat', 'c.lng')} <= 40000 "
            f"ELSE {same} END WHEN c.region IS NOT NULL THEN {same} ELSE {mention('city', 'region')} END")
    return f"""{PARSED}, {RACES}, {CITY}, f0 AS (SELECT query_id, terrain, city, month, NULLIF(km, 0) AS km, proximity,
  CASE WHEN terrain IS NOT NULL OR month IS NOT NULL OR NULLIF(km, 0) IS NOT NULL OR city IS NOT NULL THEN coalesce(search_text, '') ELSE display_query END AS x FROM parsed),
f AS (SELECT *, NULLIF({D.czech('x')}, '') AS folded, CASE WHEN month IS NULL THEN NULL WHEN last_day(make_date(1998, month, 1)) < DATE '{AS_OF}'
  THEN make_date(1999, month, 1) ELSE make_date(1998, month, 1) END AS first_day FROM f0),
named AS (SELECT DISTINCT city FROM f WHERE proximity = 1), {_NAMED.split(',', 1)[1]},
seen AS (SELECT *, {D.czech('name')} AS cname, {D.czech('city')} AS ccity FROM races WHERE {VISIBLE}),
texts AS (SELECT DISTINCT cname AS t FROM seen UNION SELECT DISTINCT ccity FROM seen),
asked AS (SELECT DISTINCT folded FROM f WHERE folded IS NOT NULL),
grams AS (SELECT t, folded, {q} AS q, {g} AS g FROM texts, asked),
hits AS (SELECT *, list_filter(range(1, len(g) + 1), lambda i: list_contains(q, g[i])) AS spots FROM grams),
starts AS (SELECT *, unnest(spots) AS i FROM hits WHERE len(spots) > 0),
runs AS (SELECT *, unnest(list_filter(spots, lambda k: k >= i)) AS j FROM starts),
sim AS (SELECT t, folded, max(len(list_intersect(q, list_distinct(g[i:j])))::DOUBLE / (len(q) + len(list_distinct(g[i:j])) - len(list_intersect(q, list_distinct(g[i:j])))))::FLOAT::DOUBLE AS s
  FROM runs GROUP BY t, folded),
met AS (SELECT f.query_id, r.race_id, r.slug, r.date_start, CASE WHEN f.folded IS NULL THEN 0 ELSE greatest(coalesce(a.s, 0), coalesce(b.s, 0)) END AS score, f.folded
  FROM f JOIN seen r ON (f.terrain IS NULL OR r.terrain = f.terrain) AND (f.month IS NULL OR date_trunc('month', r.date_start) = f.first_day)
    AND (f.km IS NULL OR len(list_filter(r.distances, lambda d: CASE WHEN f.km >= 50 THEN d.km >= 50 ELSE abs(d.km::DECIMAL(12,4) - f.km) <= f.km * 0.15 END)) > 0)
  LEFT JOIN resolved c ON f.proximity = 1 AND c.city = f.city
  LEFT JOIN sim a ON a.t = r.cname AND a.folded = f.folded LEFT JOIN sim b ON b.t = r.ccity AND b.folded = f.folded
  WHERE f.city IS NULL OR CASE WHEN f.proximity = 1 THEN {near} ELSE {mention('name', 'city', 'region')} END),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, date_start, slug) AS rank FROM met WHERE folded IS NULL OR score > 0.15)
SELECT query_id, rank::INTEGER AS rank, race_id, round(score, 5) AS score FROM ranked WHERE rank <= 100"""


@query("search_by_query", _queries_sql())
def search_by_query(spark, sf):
    """Every query text of the table, parsed and searched."""
    wanted = S.choose_parse(S.parse_queries(T.searches(spark, sf)).withColumn("model", S.validate_filters(F.lit(None).cast("string"))).drop("q"), "model")
    found = search_by_queries(wanted, T.races(spark, sf), city_dim(spark), AS_OF, digits=5)
    return found.select("query_id", "rank", "race_id", "score")


# --- Labels ------------------------------------------------------------------

_W = {"description": "NOT " + D.blank("description"), "time_start": "time_start IS NOT NULL", "distances": "len(distances) > 0",
      "price_from": "price_from IS NOT NULL", "website": "website IS NOT NULL", "registration_url": "registration_url IS NOT NULL",
      "lat": "lat IS NOT NULL", "elevation_gain": "terrain = 'trail' AND elevation_gain IS NOT NULL", "cover_url": "cover_url IS NOT NULL",
      "organizer": "organizer IS NOT NULL", "capacity": "capacity IS NOT NULL"}
_EARNED = " + ".join(f"CASE WHEN {_W[f]} THEN {w} ELSE 0 END" for f, w in V.COMPLETENESS_WEIGHTS)


@query("completeness_score", f"""WITH {RACES}, s AS (SELECT race_id, CAST(floor(100.0::DOUBLE * ({_EARNED}) / (CASE WHEN terrain = 'trail' THEN 95 ELSE 90 END) + 0.5) AS INTEGER) AS score FROM races)
SELECT race_id, score, CASE WHEN score >= 75 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN score >= 75 THEN 'Ověřené informace' WHEN score >= 40 THEN 'Základní informace' ELSE 'Málo informací' END AS label FROM s""")
def completeness_score(spark, sf):
    races = T.races(spark, sf)
    return races.select("race_id", L.completeness_of(races).alias("c")).select("race_id", "c.score", "c.level", "c.label")


def _num(x):
    return f"regexp_replace(CAST(CAST({x} AS DECIMAL(20,6)) AS VARCHAR), '\\.?0+$', '')"


_label("distance_label", lambda: L.distance_label(F.col("distances")), "coalesce(NULLIF(array_to_string(list_transform(distances, lambda d: CASE WHEN d.km >= 1 "
       f"THEN {_num('d.km')} || ' km' ELSE {_num('d.km * 1000')} || ' m' END), ' / '), ''), 'Neuvedeno')")
_label("price_label", lambda: L.price_label(F.col("price_from"), F.col("price_to")), "CASE WHEN price_from IS NOT NULL AND price_to IS NOT NULL THEN price_from || '–' || price_to || ' Kč' "
       "WHEN price_from = 0 THEN 'Zdarma' WHEN price_from IS NOT NULL THEN 'od ' || price_from || ' Kč' ELSE 'Neuvedeno' END")
_label("terrain_label", lambda: L.terrain_label(F.col("terrain")), f"coalesce({D.lookup(V.TERRAIN_LABELS, 'terrain')}, terrain)")
_label("location_label", lambda: L.location_label(F.col("city"), F.col("region")), "CASE WHEN region IS NOT NULL AND region <> city THEN city || ', ' || region ELSE city END")
_label("share_url", lambda: L.share_url("https://example.org", F.col("slug"), F.col("name")), "'https://example.org/zavod/' || url_encode(slug) || '?ref=' || url_encode(name)")
_label("render_date", lambda: F.concat_ws(" | ", L.date_short(F.col("date_start")), L.date_long(F.col("date_start"))),
       "day(date_start) || '. ' || month(date_start) || '. ' || year(date_start) || ' | ' || "
       f"([{', '.join(repr(d) for d in V.WEEKDAYS)}])[isodow(date_start)] || ' ' || day(date_start) || '. ' || ([{', '.join(repr(m) for m in V.MONTHS_GENITIVE)}])[month(date_start)] || ' ' || year(date_start)")
_label("remap_enum", lambda: L.remap_terrain(F.col("terrain")), "CASE WHEN terrain = 'ultra' THEN 'trail' ELSE terrain END")


@query("plural_label", f"WITH {RACES} SELECT city, day, n, n || ' ' || CASE WHEN n = 1 THEN 'závod' WHEN n BETWEEN 2 AND 4 THEN 'závody' ELSE 'závodů' END AS value FROM (SELECT city, CAST(date_trunc('month', date_start) AS DATE)::VARCHAR AS day, count(*) AS n FROM races GROUP BY 1, 2)")
def plural_label(spark, sf):
    n = T.races(spark, sf).groupBy("city", F.trunc("date_start", "month").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("city", "day", "n", F.concat(F.col("n").cast("string"), F.lit(" "), L.plural_label(F.col("n"))).alias("value"))


# --- Counts and checks -------------------------------------------------------

@query("terrain_counts", f"WITH {RACES} SELECT terrain, count(*) AS n FROM races WHERE {VISIBLE} GROUP BY 1")
def terrain_counts(spark, sf):
    return T.races(spark, sf).filter(P.visible(AS_OF)).groupBy("terrain").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_regions", f"WITH {RACES} SELECT DISTINCT region FROM races WHERE {VISIBLE} AND region IS NOT NULL")
def distinct_regions(spark, sf):
    return T.races(spark, sf).filter(P.visible(AS_OF) & F.col("region").isNotNull()).select("region").distinct().orderBy("region")


@query("dq_unique_slug", f"WITH {RACES} SELECT name AS slug, count(*) AS n FROM races WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dq_unique_slug(spark, sf):
    """Checked on names, which do repeat."""
    return Q.duplicates(T.races(spark, sf).select(F.col("name").alias("slug")), "slug")


@query("dq_unique_url", f"WITH {RACES} SELECT official_url, count(*) AS n FROM races WHERE official_url IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dq_unique_url(spark, sf):
    return Q.duplicates(T.races(spark, sf), "official_url")


@query("dq_domains", f"""WITH {RACES} SELECT 'terrain' AS column_name, count(*) FILTER (WHERE terrain NOT IN ('road','trail','cross','obstacle','mixed')) AS n_bad FROM races
UNION ALL SELECT 'status', count(*) FILTER (WHERE status NOT IN ('confirmed','tentative','cancelled')) FROM races
UNION ALL SELECT 'extraction_status', count(*) FILTER (WHERE extraction_status NOT IN ('pending','extracted','failed','stale','no_url','complete')) FROM races""")
def dq_domains(spark, sf):
    return Q.out_of_domain(T.races(spark, sf), Q.RACE_DOMAINS)


@query("dq_not_null", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null FROM races" for c in ("slug", "name", "region", "website")).join([f"WITH {RACES} ", ""]))
def dq_not_null(spark, sf):
    return Q.null_counts(T.races(spark, sf), ["slug", "name", "region", "website"])
