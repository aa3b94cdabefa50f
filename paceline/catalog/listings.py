"""Queries over raw listings: scans, parsers, grouping, merging, batch statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceline import fixed_values as V
from paceline.catalog import duck as D
from paceline.catalog import tables as T
from paceline.catalog.registry import load, query
from paceline.functions import labels as L
from paceline.functions import parse as P
from paceline.functions import text as X
from paceline.operators import merge as M
from paceline.operators import normalize as N
from paceline.operators import quality as Q
from paceline.operators import resolve as R
from paceline.operators.ordering import numbered_within
from paceline.plans import integrate as I
from paceline.session import scratch_path
from paceline.sources import listings as S
from paceline.streaming import flows as W


def show(distances):
    return F.array_join(F.transform(distances, lambda d: F.concat(d["label"], F.lit("="), d["km"].cast("string"))), " | ")


# --- Scans -------------------------------------------------------------------

_PRINT = "concat_ws('|', " + ", ".join(f"coalesce({c}, '~')" for c in V.RAW_FIELDS) + ")"


def _dataset(spark, sf, line=None):
    """The listings as JSON lines in the dataset folders of their sources; as changed text, if ``line`` changes it."""
    root, raw = scratch_path(spark, "datasets"), T.raw_listings(spark, sf)
    for folder, source in V.SOURCE_DIRS.items():
        rows, path = raw.filter(F.col("source") == source), f"{root}/{folder}/{V.DATASET_SUBDIR}"
        if line is None:
            rows.select(*V.RAW_FIELDS).write.json(path)
        else:
            rows.select(line(F.to_json(F.struct(*V.RAW_FIELDS)))).write.text(path)
    return root


@query("scan_sources", f"WITH {D.RAW} SELECT source, md5({_PRINT}) AS print, count(*) AS n FROM raw GROUP BY ALL")
def scan_sources(spark, sf):
    """Listings written to the dataset folders and loaded from there; all fields of every row count."""
    loaded = S.load_sources(spark, _dataset(spark, sf), multi_line=False)
    return loaded.groupBy("source", F.md5(F.expr(_PRINT)).alias("print")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_corrupt_rows", f"WITH {D.RAW} SELECT source, CASE WHEN length(title) % 5 = 0 THEN 'quarantine' ELSE 'good' END AS kind, count(*) AS n FROM raw GROUP BY ALL")
def scan_corrupt_rows(spark, sf):
    """Some records are cut short in their file; they are set aside, not fatal."""
    cut = lambda t: F.when(F.length("title") % 5 == 0, F.substr(t, F.lit(1), F.length(t) - 5)).otherwise(t)
    good, bad = S.split_corrupt(S.read_listings(spark, _dataset(spark, sf, cut), multi_line=False, names="*.txt"))
    both = good.select("source", F.lit("good").alias("kind"), "title").unionByName(bad.select("source", F.lit("quarantine").alias("kind"), "title"))
    # The count looks at a data column, as Spark refuses a read of the corrupt text alone.
    return both.groupBy("source", "kind").agg(F.count_if(F.coalesce(F.length("title"), F.lit(0)) >= 0).alias("n"))


_FATE = f"CASE WHEN length(r.title) % 5 = 0 THEN 'unreadable' WHEN {D.blank('r.title')} OR {D.blank('r.date')} THEN 'incomplete' ELSE coalesce(i.reject_reason, 'accepted') END"


@query("stream_quarantine", D.from_items(f"SELECT r.source, {_FATE} AS outcome, count(*) AS n FROM raw r JOIN items0 i ON r.ord = i.ord GROUP BY ALL"))
def stream_quarantine(spark, sf):
    """Listings, some cut short, taken in by micro-batches: what is accepted and what is set aside, and why."""
    cut = lambda t: F.when(F.length("title") % 5 == 0, F.substr(t, F.lit(1), F.length(t) - 5)).otherwise(t)
    root, (out, checkpoint) = _dataset(spark, sf, cut), W.stream_paths(spark, "ingest")
    aside = scratch_path(spark, "quarantine")
    stream = W.raw_stream(spark, root, multi_line=False, names="*.txt", maxFilesPerTrigger=3)
    W.drain_batches(stream, W.ingest_flow(out, aside), checkpoint)
    good, bad = spark.read.parquet(out), spark.read.parquet(aside)
    both = good.select("source", F.lit("accepted").alias("outcome")).unionByName(bad.select("source", F.col("reason").alias("outcome")))
    return both.groupBy("source", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("scan_required_fields", f"WITH {D.RAW} SELECT ord, startPlace FROM raw WHERE NOT {D.blank('startPlace')} AND NOT {D.blank('title')}")
def scan_required_fields(spark, sf):
    return S.require_fields(T.raw_listings(spark, sf), "startPlace", "title").select("ord", "startPlace")


@query("union_sources", f"WITH {D.RAW} SELECT ord, source, title FROM raw")
def union_sources(spark, sf):
    raw = T.raw_listings(spark, sf)
    return S.union_sources(*[raw.filter(F.col("source") == s) for s in V.SOURCE_DIRS.values()]).select("ord", "source", "title")


# --- Parsers, one row per listing --------------------------------------------

def _column(name, spark_col, duck_expr, *inputs):
    """Register a row-wise parser: listing order and its result."""
    def run(spark, sf):
        return T.raw_listings(spark, sf).select("ord", spark_col(*[F.col(c) for c in inputs]).alias("value"))

    query(name, f"WITH {D.RAW} SELECT ord, {duck_expr(*inputs)} AS value FROM raw")(run)


@query("normalize_text", f"SELECT doc_id, {D.norm('text')} AS value FROM documents")
def normalize_text(spark, sf):
    return load(spark, sf, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("value"))


@query("normalize_czech", f"SELECT doc_id, {D.czech('text')} AS value FROM documents")
def normalize_czech(spark, sf):
    return load(spark, sf, "documents").select("doc_id", X.normalize_czech(F.col("text")).alias("value"))


_column("normalize_date", P.normalize_date, D.date, "date")
_column("extractor_date", P.extractor_date, lambda d, s: (
    f"coalesce(CASE WHEN {s} = 'ceskybeh' THEN {D.worded(D.trim(f'''string_split({d}, '–')[1]'''), '[A-Za-z0-9_]+', False)} "
    f"ELSE {D.dotted(d)} END, {d})"), "date", "source")
_column("parse_distances", lambda c: show(P.parse_distances(c)), lambda c: D.show(D.distances(c)), "distance")
_column("sort_distances", lambda c: show(P.sort_distances(P.parse_distances(c))), lambda c: D.show(D.by_km(D.distances(c))), "distance")
_column("surface_to_terrain", P.surface_to_terrain, D.terrain, "surface")
_column("normalize_time", P.normalize_time, D.clock, "startTime")
_column("normalize_city", P.normalize_city, D.city, "city")
_column("normalize_region", P.normalize_region, D.region, "region")
_column("dict_lookup", lambda c: F.coalesce(P.lookup(V.REGIONS, F.lower(c)), F.lit("?")), lambda c: f"coalesce({D.lookup(V.REGIONS, f'lower({c})')}, '?')", "region")
_column("filter_foreign", P.is_foreign_region, D.foreign, "region")
_column("normalize_website", P.normalize_website, D.website, "website")
_column("url_dedup_key", P.url_dedup_key, D.url_key, "website")
_column("parse_fee", P.parse_fee, D.fee, "feeOnSite")
_column("extract_organizer", P.extract_organizer, D.organizer, "contact")
_column("contact_extract", P.contact_extract, lambda c: (
    f"concat_ws(', ', NULLIF(regexp_extract({c}, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\\.[A-Za-z0-9_]+'), ''), "
    f"NULLIF(regexp_extract({c}, '[0-9]{{3}}{D.B}?[0-9]{{3}}{D.B}?[0-9]{{3}}'), ''))"), "contact")


@query("price_bounds", D.from_items("SELECT ord, priceFrom AS low, priceTo AS high FROM items"))
def price_bounds(spark, sf):
    return N.accepted(N.normalize_items(T.raw_listings(spark, sf))).select(
        "ord", F.col("priceFrom").alias("low"), F.col("priceTo").alias("high"))


@query("parse_location", f"""WITH {D.RAW}, t AS (SELECT ord, city || ', ' || startPlace || ' , okres ' || city || ', kraj ' || region AS a,
  city || ', ' || startPlace || ' , Kraj: ' || region AS b FROM raw)
SELECT ord, {D.trim("string_split(a, ',')[1]")} AS city_a,
  coalesce(substr(list_filter(list_transform(string_split(a, ','), lambda p: {D.trim('p')}), lambda p: starts_with(p, 'okres '))[1], 7), '') AS district_a,
  coalesce(substr(list_filter(list_transform(string_split(a, ','), lambda p: {D.trim('p')}), lambda p: starts_with(p, 'kraj '))[1], 6), '') AS region_a,
  coalesce(list_filter(list_transform(string_split(regexp_replace(b, ',?{D.B}*Kraj:.*$', ''), ','), lambda p: {D.trim('p')}), lambda p: p <> '')[1], '') AS city_b,
  array_to_string(list_filter(list_transform(string_split(regexp_replace(b, ',?{D.B}*Kraj:.*$', ''), ','), lambda p: {D.trim('p')}), lambda p: p <> '')[2:], ', ') AS place_b,
  {D.trim(f"regexp_replace(b, '^.*Kraj:{D.B}*', '')")} AS region_b FROM t""")
def parse_location(spark, sf):
    t = T.raw_listings(spark, sf).selectExpr(
        "ord", "city || ', ' || startPlace || ' , okres ' || city || ', kraj ' || region AS a",
        "city || ', ' || startPlace || ' , Kraj: ' || region AS b")
    return t.select("ord", P.parse_location_named(F.col("a")).alias("a"), P.parse_location_place(F.col("b")).alias("b")).select(
        "ord", F.col("a.city").alias("city_a"), F.col("a.district").alias("district_a"), F.col("a.region").alias("region_a"),
        F.col("b.city").alias("city_b"), F.col("b.start_place").alias("place_b"), F.col("b.region").alias("region_b"))


@query("split_place_time", f"""WITH {D.RAW}, t AS (SELECT ord, startPlace || ', ' || startTime AS a FROM raw)
SELECT ord, {D.trim(f"regexp_replace(regexp_replace(regexp_replace(a, '[0-9]{{1,2}}[:.][0-9]{{2}}', ''), ',{D.B}*$', ''), '^{D.B}*,', '')")} AS place,
  replace(regexp_extract(a, '[0-9]{{1,2}}[:.][0-9]{{2}}'), '.', ':') AS time FROM t""")
def split_place_time(spark, sf):
    t = T.raw_listings(spark, sf).select("ord", P.split_place_time(F.concat("startPlace", F.lit(", "), "startTime")).alias("r"))
    return t.select("ord", "r.place", "r.time")


@query("strip_label_prefix", f"""WITH {D.RAW} SELECT ord, regexp_replace('Délka tratí: ' || distance, '^Délka tratí:{D.B}*', '') AS distance,
  regexp_replace('Typ závodu:' || surface, '^Typ závodu:{D.B}*', '') AS surface, regexp_extract(startTime, '[0-9]{{1,2}}:[0-9]{{2}}') AS start FROM raw""")
def strip_label_prefix(spark, sf):
    return T.raw_listings(spark, sf).select(
        "ord", P.strip_label(F.concat(F.lit("Délka tratí: "), "distance"), "Délka tratí").alias("distance"),
        P.strip_label(F.concat(F.lit("Typ závodu:"), "surface"), "Typ závodu").alias("surface"),
        P.first_clock(F.col("startTime")).alias("start"))


ITEM_COLUMNS = ["ord", "source", "title", "date", "city", "region", "terrain", "startTime", "website", "priceFrom",
                "priceTo", "description", "contact"]


@query("normalize_item", D.from_items(f"SELECT {', '.join(ITEM_COLUMNS)}, {D.show('distances')} AS distances FROM items"))
def normalize_item(spark, sf):
    return N.accepted(N.normalize_items(T.raw_listings(spark, sf))).select(*ITEM_COLUMNS, show("distances").alias("distances"))


@query("filter_bad_date", D.from_items("SELECT reject_reason, count(*) AS n FROM items0 WHERE reject_reason IS NOT NULL GROUP BY 1"))
def filter_bad_date(spark, sf):
    return N.rejected(N.normalize_items(T.raw_listings(spark, sf))).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


# --- Grouping ----------------------------------------------------------------

def _items(spark, sf):
    return N.accepted(N.normalize_items(T.raw_listings(spark, sf)))


def _groups(spark, sf):
    return M.resolve_items(_items(spark, sf))


@query("dedup_url_date", D.from_groups("SELECT date, first_ord, n_rows FROM exact WHERE phase = 1"))
def dedup_url_date(spark, sf):
    return R.exact_groups(R.with_group_key(_items(spark, sf))).filter("phase = 1").select("date", "first_ord", "n_rows")


@query("dedup_composite", D.from_groups("SELECT date, first_ord, n_rows FROM exact WHERE phase = 2"))
def dedup_composite(spark, sf):
    return R.exact_groups(R.with_group_key(_items(spark, sf))).filter("phase = 2").select("date", "first_ord", "n_rows")


@query("fuzzy_pairs", D.from_groups(f"""SELECT x.date AS date, x.first_ord AS a, y.first_ord AS b FROM
  (SELECT date, min(first_ord) AS first_ord, names, cities FROM nodes GROUP BY date, names, cities) x
  JOIN (SELECT date, min(first_ord) AS first_ord, names, cities FROM nodes GROUP BY date, names, cities) y
  ON x.date = y.date AND x.first_ord < y.first_ord AND {D.jaccard('x.names', 'y.names')} >= 0.6::DOUBLE AND {D.overlap('x.cities', 'y.cities')}"""))
def fuzzy_pairs(spark, sf):
    return R.fuzzy_pairs(R.exact_groups(R.with_group_key(_items(spark, sf))))


@query("dedup_fuzzy", D.from_groups("SELECT date, first_ord, group_id FROM ids WHERE phase = 2"))
def dedup_fuzzy(spark, sf):
    return M.resolve_items(_items(spark, sf))[1].filter("phase = 2").select("date", "first_ord", "group_id")


@query("group_order", D.from_groups("SELECT group_id, phase, min(first_ord) AS first_ord, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM ids GROUP BY 1, 2"))
def group_order(spark, sf):
    return _groups(spark, sf)[1].groupBy("group_id", "phase").agg(F.min("first_ord").alias("first_ord"), F.sum("n_rows").alias("n_rows"))


@query("token_set", f"SELECT doc_id, array_to_string({D.token_set(D.norm('text'))}, ' ') AS value FROM documents")
def token_set(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id", F.array_join(F.sort_array(X.token_set(X.normalize_text(F.col("text")))), " ").alias("value"))


def _title_city(spark, sf):
    def tok(c):
        return X.token_set(X.normalize_text(F.col(c)))

    raw = T.raw_listings(spark, sf)
    return raw.select("ord", tok("title").alias("a"), X.token_set(X.normalize_text(F.concat_ws(" ", F.lit("Jarní běh"), "surface", "city"))).alias("b"), tok("city").alias("c"))


_TC = (f"WITH {D.RAW}, t AS (SELECT ord, {D.token_set(D.norm('title'))} AS a, "
       f"{D.token_set(D.norm('''concat_ws(' ', 'Jarní běh', surface, city)'''))} AS b, {D.token_set(D.norm('city'))} AS c FROM raw) ")


@query("jaccard_tokens", _TC + f"SELECT ord, round({D.jaccard('a', 'b')}, 6) AS value FROM t")
def jaccard_tokens(spark, sf):
    return _title_city(spark, sf).select("ord", F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("value"))


@query("tokens_overlap", _TC + f"SELECT ord, CAST({D.overlap('c', 'b')} AS INTEGER) AS value FROM t")
def tokens_overlap(spark, sf):
    return _title_city(spark, sf).select("ord", X.tokens_overlap(F.col("c"), F.col("b")).cast("int").alias("value"))


# --- Merging -----------------------------------------------------------------

def _scalar(label, **columns):
    """Register surviving fields of the merged groups."""
    def run(spark, sf):
        merged = M.merge_scalars(*_groups(spark, sf))
        return merged.select("group_id", *[F.expr(e).alias(c) for c, e in columns.items()])

    query(label, D.from_merged(f"SELECT group_id, {', '.join(columns)} FROM merged"))(run)


_scalar("pick_longest", name="coalesce(name, '')", description="description")
_scalar("pick_shortest", city="coalesce(city, '')")
_scalar("pick_first", time_start="time_start", region="region", website="website")
_scalar("price_envelope", price_from="price_from", price_to="price_to")
_scalar("source_list", source="array_join(sort_array(sources), ',')")
_scalar("organizer_pick", organizer="coalesce(preferred.name, any_organizer)")


@query("pick_terrain", D.from_merged("SELECT group_id, terrain FROM merged"))
def pick_terrain(spark, sf):
    return M.merge_scalars(*_groups(spark, sf)).select("group_id", M.terrain_of_rank(F.col("terrain_rank")).alias("terrain"))


@query("merge_distances", D.from_merged(f"SELECT group_id, {D.show('distances')} AS distances FROM merged WHERE len(distances) > 0"))
def merge_distances(spark, sf):
    keyed, ids = _groups(spark, sf)
    return M.merge_distances(M.distance_entries(keyed, ids), ["group_id"]).select("group_id", show("distances").alias("distances"))


_MERGED = "name, description, date_start, time_start, city, region, terrain, price_from, price_to, website, organizer, source"


@query("merge_group", D.from_merged(f"SELECT group_id, n_rows, {_MERGED}, {D.show('distances')} AS distances FROM merged"))
def merge_group(spark, sf):
    merged = M.merge_groups(*_groups(spark, sf))
    return merged.select("group_id", "n_rows", *_MERGED.split(", "), show("distances").alias("distances"))


def _merged(spark, sf):
    return M.merge_groups(*_groups(spark, sf))


@query("shared_url_null", D.from_races("SELECT group_id, website, official_url FROM final"))
def shared_url_null(spark, sf):
    return M.null_shared_urls(_merged(spark, sf)).select("group_id", "website", "official_url")


@query("assign_slugs", D.from_races("SELECT group_id, slug FROM races"))
def assign_slugs(spark, sf):
    return M.assign_slugs(_merged(spark, sf)).select("group_id", "slug")


@query("slugify", D.from_items(f"SELECT ord, {D.slug('title', 'date')} AS value FROM items"))
def slugify(spark, sf):
    return _items(spark, sf).select("ord", L.slug_base(F.col("title"), F.col("date")).alias("value"))


@query("integrate_listings", D.from_races(f"SELECT slug, {_MERGED}, official_url, {D.show('distances')} AS distances FROM races"))
def integrate_listings(spark, sf):
    """The whole batch, from raw rows to slugged races; nothing reused."""
    races = I.integrate(T.raw_listings(spark, sf))
    return races.select("slug", *_MERGED.split(", "), "official_url", show("distances").alias("distances"))


@query("sink_json", D.from_races("SELECT count(*) AS n, count(DISTINCT slug) AS slugs, count(official_url) AS urls, CAST(sum(len(distances)) AS BIGINT) AS distances FROM races"))
def sink_json(spark, sf):
    """Write merged races as JSON lines and count what is read back."""
    path = scratch_path(spark, "races-json")
    races = M.finish(_merged(spark, sf)).select(*I.RACE_COLUMNS)
    S.write_json(races, path)
    back = spark.read.schema(races.schema).json(path)
    return back.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("slug").alias("slugs"), F.count("official_url").alias("urls"),
        F.sum(F.size("distances")).alias("distances"))


# --- Batch statistics --------------------------------------------------------

@query("stats_terrain", D.from_merged("SELECT terrain, count(*) AS n FROM merged GROUP BY 1"))
def stats_terrain(spark, sf):
    return Q.stats_terrain(_merged(spark, sf))


@query("stats_source", D.from_merged("SELECT s AS source, count(*) AS n FROM (SELECT unnest(string_split(source, ',')) AS s FROM merged) GROUP BY 1"))
def stats_source(spark, sf):
    return Q.stats_source(_merged(spark, sf))


@query("stats_coverage", D.from_races("""SELECT count(*) AS total, count(*) FILTER (WHERE contains(source, ',')) AS multi_source,
  count(official_url) AS with_url, count(*) - count(official_url) AS without_url, count(price_from) AS with_price FROM races"""))
def stats_coverage(spark, sf):
    return Q.stats_coverage(M.null_shared_urls(_merged(spark, sf)))


_COUNTERS = D.from_merged("""SELECT 'raw' AS stage, count(*) AS n FROM raw
  UNION ALL SELECT coalesce(reject_reason, 'normalized'), count(*) FROM items0 GROUP BY 1
  UNION ALL SELECT 'merged', count(*) FROM merged
  UNION ALL SELECT 'nullified_urls', CAST(coalesce(sum(c), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM merged WHERE website IS NOT NULL GROUP BY website HAVING count(*) > 1)""")


@query("pipeline_counters", _COUNTERS)
@query("stage_counters", _COUNTERS)
def stage_counters(spark, sf):
    return I.stage_counters(T.raw_listings(spark, sf), _merged(spark, sf))


@query("numbered_within", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders")
def ordered_numbers(spark, sf):
    """Row numbers within three very large keys."""
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return numbered_within(orders, ["o_orderstatus"], "o_orderkey", "n").select("o_orderkey", "n")
