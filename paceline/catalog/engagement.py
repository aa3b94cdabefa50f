"""Queries over interest, referrals, reports, upserts, pages and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceline.catalog import duck as D
from paceline.catalog import tables as T
from paceline.catalog.registry import load, query
from paceline.catalog.searching import RACES
from paceline.operators import engage as E
from paceline.operators import filters as P
from paceline.operators import quality as Q
from paceline.operators import upsert as U
from paceline.operators.throttle import throttle
from paceline.session import scratch_path, stage
from paceline.sources import listings as S
from paceline.sources import pages as G
from paceline.streaming import flows as W

INTEREST = f"interest AS ({T.text(T.INTEREST_NARROW)})"
WIDE = f"interest AS ({T.text(T.INTEREST)})"
REFERRALS = f"referrals AS ({T.text(T.REFERRALS)})"
REPORTS = f"reports AS ({T.text(T.REPORTS)})"


def interest(spark, sf):
    return T.view(spark, sf, T.INTEREST_NARROW)


def reports(spark, sf):
    return T.view(spark, sf, T.REPORTS).withColumn("reasons", F.filter(F.split("reasons", ","), lambda r: r != ""))


# Asked or deleted pairs: the views' own pairs shifted by one race, so that some exist.
_ASKED = "asked AS (SELECT DISTINCT user_id, race_id + 1 AS race_id FROM interest WHERE user_id IS NOT NULL)"


def asked(spark, sf):
    return interest(spark, sf).filter("user_id IS NOT NULL").select("user_id", (F.col("race_id") + 1).alias("race_id")).distinct()


# --- Interest ----------------------------------------------------------------

_ONCE = """once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, race_id ORDER BY created_at, id) AS rn FROM interest)
  WHERE rn = 1 OR user_id IS NULL)"""


@query("unique_interest", f"WITH {INTEREST}, {_ONCE} SELECT id, race_id, user_id FROM once")
def unique_interest(spark, sf):
    return E.unique_interest(interest(spark, sf)).select("id", "race_id", "user_id")


@query("append_interest", f"WITH {INTEREST}, {_ONCE}, {_ASKED} SELECT id, race_id, user_id FROM once o WHERE user_id IS NULL "
       "OR NOT EXISTS (SELECT 1 FROM asked a WHERE a.user_id = o.user_id AND a.race_id = o.race_id)")
def append_interest(spark, sf):
    rows = interest(spark, sf)
    return E.append_interest(asked(spark, sf), rows).select("id", "race_id", "user_id")


@query("remove_interest", f"WITH {INTEREST}, {_ASKED} SELECT id, race_id, user_id FROM interest o WHERE user_id IS NULL "
       "OR NOT EXISTS (SELECT 1 FROM asked a WHERE a.user_id = o.user_id AND a.race_id = o.race_id)")
def remove_interest(spark, sf):
    return E.remove_interest(interest(spark, sf), asked(spark, sf)).select("id", "race_id", "user_id")


@query("has_interest", f"WITH {INTEREST}, {_ASKED} SELECT user_id, race_id FROM asked a WHERE EXISTS (SELECT 1 FROM interest i WHERE i.user_id = a.user_id AND i.race_id = a.race_id)")
def has_interest(spark, sf):
    return E.has_interest(asked(spark, sf), interest(spark, sf)).select("user_id", "race_id")


@query("append_referral", f"WITH {REFERRALS}, {INTEREST} SELECT id, referrer_id, referred_id, race_id FROM referrals "
       "UNION ALL SELECT id, referred_by, user_id, race_id FROM interest WHERE referred_by IS NOT NULL AND user_id IS NOT NULL")
def append_referral(spark, sf):
    return E.append_referrals(T.view(spark, sf, T.REFERRALS), interest(spark, sf)).select("id", "referrer_id", "referred_id", "race_id")


@query("interest_count", f"WITH {INTEREST} SELECT race_id, count(*) AS n FROM interest GROUP BY 1")
def interest_count(spark, sf):
    return E.interest_counts(interest(spark, sf))


@query("join_user_races", f"WITH {WIDE}, {RACES} SELECT i.id, i.user_id, r.slug, r.city FROM interest i JOIN races r USING (race_id) WHERE i.user_id IS NOT NULL")
def join_user_races(spark, sf):
    races = T.races(spark, sf).select("race_id", "slug", "city")
    return E.user_races(T.view(spark, sf, T.INTEREST), races).select("id", "user_id", "slug", "city")


@query("my_races_order", f"WITH {WIDE}, {RACES} SELECT i.id, r.slug, row_number() OVER (ORDER BY i.created_at DESC, i.id) AS pos FROM interest i JOIN races r USING (race_id) WHERE i.user_id = 7")
def my_races_order(spark, sf):
    """One user's races, newest first, with their position."""
    from pyspark.sql import Window

    mine = E.user_races(T.view(spark, sf, T.INTEREST), T.races(spark, sf).select("race_id", "slug"), F.lit(7))
    by_user = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "id")
    return mine.select("id", "slug", F.row_number().over(by_user).cast("bigint").alias("pos")).orderBy("pos")


@query("own_rows", f"WITH {REFERRALS} SELECT id, referred_id, race_id FROM referrals WHERE referrer_id = 10")
def own_rows(spark, sf):
    return T.view(spark, sf, T.REFERRALS).filter(P.owned_by(10, "referrer_id")).select("id", "referred_id", "race_id")


# --- References --------------------------------------------------------------

@query("dq_orphans", f"WITH {WIDE}, {RACES} SELECT id, race_id FROM interest WHERE race_id NOT IN (SELECT race_id FROM races)")
def dq_orphans(spark, sf):
    return Q.orphans(T.view(spark, sf, T.INTEREST), T.races(spark, sf), "race_id").select("id", "race_id")


_GONE = "gone AS (SELECT race_id FROM races WHERE status = 'cancelled')"


@query("fk_orphans", f"""WITH {WIDE}, {RACES}, {_GONE}
SELECT 'cascade' AS rule, i.id, i.race_id, i.referred_by FROM interest i WHERE i.race_id NOT IN (SELECT race_id FROM gone)
UNION ALL SELECT 'set_null', i.id, i.race_id, CASE WHEN i.referred_by IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') THEN i.referred_by END FROM interest i""")
def fk_orphans(spark, sf):
    """Delete cancelled races with their interest; clear referrers that are no known users."""
    rows = T.view(spark, sf, T.INTEREST).select("id", "race_id", "referred_by")
    gone = T.races(spark, sf).filter("status = 'cancelled'").select("race_id")
    users = load(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("referred_by"))
    left = E.cascade(rows, gone, "race_id").select(F.lit("cascade").alias("rule"), "id", "race_id", "referred_by")
    cleared = E.set_null(rows, users, "referred_by").select(F.lit("set_null").alias("rule"), "id", "race_id", "referred_by")
    return left.unionByName(cleared)


# --- Reports -----------------------------------------------------------------

@query("filter_report_valid", f"WITH {REPORTS} SELECT id FROM reports WHERE reasons <> '' OR length(message) > 0")
def filter_report_valid(spark, sf):
    return reports(spark, sf).filter(P.report_valid()).select("id")


@query("open_reports", f"WITH {REPORTS} SELECT id, race_id FROM reports WHERE NOT resolved")
def open_reports(spark, sf):
    return reports(spark, sf).filter(P.open_report()).select("id", "race_id")


@query("anti_recent", """WITH b AS (SELECT event_id AS id, user_id % 5 AS race_id, ts AS created_at FROM events WHERE event_type = 'error'),
h AS (SELECT user_id % 5 AS race_id, ts AS created_at FROM events WHERE event_type <> 'error')
SELECT id, race_id FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.race_id = b.race_id AND h.created_at <= b.created_at AND h.created_at > b.created_at - INTERVAL 60 SECONDS)""")
def anti_recent(spark, sf):
    """New reports (errors) against stored ones (all other events)."""
    events = load(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("race_id"), F.col("ts").cast("timestamp").alias("created_at"), "event_type")
    new, stored = events.filter("event_type = 'error'"), events.filter("event_type <> 'error'")
    return E.anti_recent(new, stored.select("race_id", "created_at")).select("id", "race_id")


# --- Growth ------------------------------------------------------------------

@query("funnel_rates", """WITH s0 AS (SELECT user_id, min(ts) AS at FROM events WHERE event_type = 'view' GROUP BY 1),
s1 AS (SELECT e.user_id, min(ts) AS at FROM events e JOIN s0 ON e.user_id = s0.user_id AND e.ts >= s0.at WHERE event_type = 'signup' GROUP BY 1),
s2 AS (SELECT e.user_id, min(ts) AS at FROM events e JOIN s1 ON e.user_id = s1.user_id AND e.ts >= s1.at WHERE event_type = 'click' GROUP BY 1),
s3 AS (SELECT e.user_id, min(ts) AS at FROM events e JOIN s2 ON e.user_id = s2.user_id AND e.ts >= s2.at WHERE event_type = 'purchase' GROUP BY 1),
n AS (SELECT 0 AS step, 'view' AS name, count(*) AS users FROM s0 UNION ALL SELECT 1, 'signup', count(*) FROM s1 UNION ALL SELECT 2, 'click', count(*) FROM s2 UNION ALL SELECT 3, 'purchase', count(*) FROM s3)
SELECT step, name, users, round(users / lag(users) OVER (ORDER BY step), 6) AS rate FROM n""")
def funnel_rates(spark, sf):
    return E.funnel_rates(load(spark, sf, "events"))


@query("referred_share", f"WITH {INTEREST} SELECT count(*) AS signups, count(referred_by) AS referred, round(count(referred_by) / count(*), 6) AS share FROM interest WHERE user_id IS NOT NULL")
def referred_share(spark, sf):
    return E.referred_share(interest(spark, sf))


@query("viral_coefficient", f"""WITH {INTEREST}, {REFERRALS},
u AS (SELECT CAST(date_trunc('week', created_at) AS DATE) AS w, count(DISTINCT user_id) AS users FROM interest WHERE user_id IS NOT NULL GROUP BY 1),
r AS (SELECT CAST(date_trunc('week', created_at) AS DATE) AS w, count(*) AS n FROM referrals GROUP BY 1)
SELECT CAST(w AS VARCHAR) AS week, users, coalesce(n, 0) AS referrals, round(coalesce(n, 0) / users, 6) AS k FROM u LEFT JOIN r USING (w)""")
def viral_coefficient(spark, sf):
    return E.viral_coefficient(interest(spark, sf), T.view(spark, sf, T.REFERRALS)).withColumn("week", F.col("week").cast("string"))


@query("referrer_leaderboard", f"WITH {REFERRALS} SELECT referrer_id, n, dense_rank() OVER (ORDER BY n DESC) AS rank FROM (SELECT referrer_id, count(*) AS n FROM referrals GROUP BY 1)")
def referrer_leaderboard(spark, sf):
    return E.referrer_leaderboard(T.view(spark, sf, T.REFERRALS))


@query("referred_retention", f"""WITH {REFERRALS}, c AS (SELECT referred_id AS user_id, min(CAST(date_trunc('week', created_at) AS DATE)) AS cohort FROM referrals GROUP BY 1),
a AS (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) AS week FROM events)
SELECT CAST(cohort AS VARCHAR) AS cohort, CAST((week - cohort) // 7 AS INTEGER) AS weeks_later, count(*) AS users FROM c JOIN a USING (user_id) WHERE week >= cohort GROUP BY 1, 2""")
def referred_retention(spark, sf):
    return E.referred_retention(T.view(spark, sf, T.REFERRALS), load(spark, sf, "events")).withColumn("cohort", F.col("cohort").cast("string"))


# --- Upsert ------------------------------------------------------------------

# The table before: one row per order, matched partly by address, partly by slug.
OLD = """SELECT 'stary-' || CAST(o_orderkey AS STRING) AS slug, 'stary' AS name, 'ponechat' AS cover_url, o_orderkey AS race_no, CAST(NULL AS STRING) AS city,
  CASE WHEN o_orderkey % 3 = 0 THEN 'https://zavod' || CAST(o_orderkey AS STRING) || '.cz' END AS official_url,
  TIMESTAMP '1998-01-01 00:00:00' AS created_at, TIMESTAMP '1998-01-01 00:00:00' AS updated_at FROM {orders}"""
# The batch brings new races, known ones, addresses that move to another slug, slugs that another stored row holds, and repeats.
_ROW = """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'stary-' ELSE 'novy-' END || CAST(o_orderkey AS STRING) AS slug, 'novy' AS name,
  CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS city,
  CASE WHEN o_orderkey % 6 < 2 OR o_orderkey % 30 = 3 THEN 'https://zavod' || CAST(o_orderkey AS STRING) || '.cz'
    WHEN o_orderkey % 30 = 2 THEN 'https://jiny' || CAST(o_orderkey AS STRING) || '.cz' END AS official_url FROM {orders}"""
NEW = f"{_ROW} UNION ALL {_ROW} WHERE o_orderkey % 70 = 4"
_JUDGED = f"""old AS ({T.text(OLD)}), judged AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY slug) > 1 THEN 'slug repeated'
  WHEN official_url IS NOT NULL AND count(*) OVER (PARTITION BY official_url) > 1 THEN 'address repeated'
  WHEN official_url IS NOT NULL AND EXISTS (SELECT 1 FROM old o WHERE o.slug = n.slug AND o.official_url IS DISTINCT FROM n.official_url)
  THEN 'slug taken' END AS reason FROM ({T.text(NEW)}) n)"""
_UPSERT = f"""WITH {_JUDGED}, new AS (SELECT * FROM judged WHERE reason IS NULL),
step1 AS (SELECT coalesce(n.slug, o.slug) AS slug, coalesce(n.name, o.name) AS name, o.cover_url, o.race_no, CASE WHEN n.slug IS NOT NULL THEN n.city ELSE o.city END AS city,
    coalesce(o.official_url, n.official_url) AS official_url, o.created_at, n.slug IS NOT NULL AS fresh FROM old o FULL OUTER JOIN (SELECT * FROM new WHERE official_url IS NOT NULL) n ON n.official_url = o.official_url),
step2 AS (SELECT coalesce(n.slug, o.slug) AS slug, coalesce(n.name, o.name) AS name, o.cover_url, o.race_no, CASE WHEN n.slug IS NOT NULL THEN n.city ELSE o.city END AS city,
    CASE WHEN n.slug IS NULL THEN o.official_url END AS official_url, o.created_at, n.slug IS NOT NULL OR coalesce(o.fresh, false) AS fresh
  FROM step1 o FULL OUTER JOIN (SELECT * FROM new WHERE official_url IS NULL) n ON n.slug = o.slug)"""
TIMES = "WHEN created_at IS NOT NULL THEN '1998-01-01 00:00:00' ELSE '1998-06-15 00:00:00' END"


def upserted(spark, sf):
    return U.upsert_races(T.view(spark, sf, OLD), T.view(spark, sf, NEW), T.AS_OF)[0]


@query("upsert_by_key", _UPSERT + " SELECT slug, name, cover_url, race_no, city, official_url FROM step2")
def upsert_by_key(spark, sf):
    return upserted(spark, sf).select("slug", "name", "cover_url", "race_no", "city", "official_url")


@query("upsert_audit", _UPSERT + f" SELECT slug, CASE {TIMES} AS created_at, CASE WHEN fresh THEN '1998-06-15 00:00:00' ELSE '1998-01-01 00:00:00' END AS updated_at FROM step2")
def upsert_audit(spark, sf):
    return upserted(spark, sf).select("slug", F.col("created_at").cast("string").alias("created_at"), F.col("updated_at").cast("string").alias("updated_at"))


@query("upsert_clashes", f"""WITH {_JUDGED}, {RACES}, c AS (SELECT race_id, official_url, slug, count(*) OVER (PARTITION BY official_url) AS u FROM races)
SELECT 'batch' AS part, slug AS row_name, reason FROM judged UNION ALL
SELECT 'races', CAST(race_id AS VARCHAR), CASE WHEN official_url IS NOT NULL AND u > 1 THEN 'address repeated' END FROM c""")
def upsert_clashes(spark, sf):
    batch = U.judge_batch(T.view(spark, sf, OLD), T.view(spark, sf, NEW)).select(F.lit("batch").alias("part"), F.col("slug").alias("row_name"), "reason")
    races = T.races(spark, sf)
    alone = U.judge_batch(races.limit(0), races).select(F.lit("races"), F.col("race_id").cast("string"), "reason")
    return batch.union(alone)


# --- Pages -------------------------------------------------------------------

@query(
    "page_title_extract",
    "WITH x AS (SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS p FROM pages), "
    "y AS (SELECT page_id, CASE WHEN trim(regexp_replace(h, '<[^>]*>', '', 'g')) <> '' THEN h ELSE p END AS m FROM x) "
    "SELECT page_id, " + D.trim("replace(replace(replace(replace(replace(replace(regexp_replace(m, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&')") + " AS title FROM y")
def page_title_extract(spark, sf):
    return load(spark, sf, "pages").select("page_id", G.page_title(F.col("html")).alias("title"))


_ABS = """CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^[A-Za-z]+:') || h
  WHEN starts_with(h, '/') THEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || h WHEN regexp_matches(h, '^[?#]') THEN regexp_replace(url, '[?#].*$', '') || h
  ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || h END"""


@query("link_extract", f"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)href="([^"]+)"', 1)) AS h FROM pages)
SELECT DISTINCT page_id, {_ABS} AS target FROM l WHERE regexp_matches({_ABS}, '^https://[^/]*/[^/]*$') AND NOT regexp_matches({_ABS}, '^https://[^/]*/the.*$')""")
def link_extract(spark, sf):
    return G.link_extract(load(spark, sf, "pages"), "https://*/*", "https://*/the**")


# List entries with a target of their own, written from the pages' addresses.
ENTRIES = """SELECT page_id, url, '<div class="row race-single" data-location="' || url || '?"></div><pre class="race-single">x</pre>' ||
  '<div data-location="/zavod/' || CAST(page_id % 9 AS STRING) || '" class="race-single"></div><div class="race" data-location="/no"></div>' || html AS html FROM {pages}"""


@query("location_links", """SELECT DISTINCT page_id, t AS target FROM (SELECT page_id, unnest([url,
  regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || '/zavod/' || CAST(page_id % 9 AS VARCHAR)]) AS t FROM pages)""")
def location_links(spark, sf):
    return G.location_links(T.view(spark, sf, ENTRIES))


# The number in a page's own address stands for the highest one its pager links to.
PAGER = "SELECT page_id, url, '<a href=\"/strana/' || CAST(page_id % 7 + 1 AS STRING) || '/\">x</a><a href=\"/strana/' || CAST(page_id % 23 AS STRING) || '/\">y</a>' || html AS html FROM {pages}"


@query("pagination_expand", """WITH p AS (SELECT page_id, greatest(page_id % 7 + 1, page_id % 23) AS last FROM pages)
SELECT page_id, CAST(n AS INTEGER) AS n, 'https://list.example/strana/' || n || '/' AS page_url FROM (SELECT page_id, unnest(range(2, last + 1)) AS n FROM p)""")
def pagination_expand(spark, sf):
    return G.pagination_expand(T.view(spark, sf, PAGER), r"/strana/(\d+)/", "https://list.example/strana/{n}/", 2)


# Detail pages of each layout, written from the listings.
DETAIL = f"""SELECT ord AS page_id, url, source, title, date, city, region, distance, surface, startTime, startPlace, contact, cup, feeOnSite,
  CASE source
  WHEN 'behej' THEN '<html><head><title>x</title></head><body><h1> ' || title || ' </h1><table class="wide race"><tbody>'
    || '<tr><td> Den: </td><td>' || date || '</td></tr><tr><td>Místo:</td><td>' || city || ', okres Okres, kraj ' || region || '</td></tr>'
    || '<tr><td>Neznámé:</td><td>?</td></tr><tr><td>Povrch:</td><td></td></tr><tr><td>Povrch:</td><td><b>' || surface || '</b></td></tr>'
    || '<tr><td>Poháry</td><td>' || cup || '</td></tr><tr><td>Webové stránky:</td><td><a href="/go/1">web</a></td></tr></tbody></table></body></html>'
  WHEN 'ceskybeh' THEN '<html><head><title>x</title></head><body><div class="col-md-12 text-muted"><p><i class="fa fa-road"></i> mimo</p></div><h3>' || title
    || '</h3><div id="d" class="container race-detail"><div><p class="lead">popis</p></div><!-- </div> --><p><i class="fa fa-clock"></i> mimo</p>'
    || '<div class="col-md-12 text-muted"><div class="row"><div><p><i class="fa fa-calendar"></i> ' || date || '</p></div></div>'
    || '<p><i class="fa fa-clock"></i> Start: ' || startTime || '</p><p><i class="fa fa-map-marker"></i> ' || city || ', hala, Kraj: ' || region || '</p>'
    || '<p> Délka tratí: <i class="fa fa-arrows-h"></i>' || distance || '</p></div><div class="text-muted col-md-12"><p><i class="fa fa-road"></i> Typ závodu: ' || surface || '</p>'
    || '<p><i class="fa fa-user-circle"></i> ' || contact || ' <a href="https://klub.cz/x">klub</a></p></div></div><div class="col-md-12 text-muted"><p><i class="fa fa-calendar"></i> mimo</p></div></body></html>'
  ELSE '<html><head><title>' || title || '</title></head><body><h1></h1><div class="terms__item"><div class="terms__note">Datum konání</div> <div class="terms__text">' || date || '</div></div>'
    || '<div class="terms__item"><div class="terms__note">Místo a čas startu</div><div class="terms__text">' || startPlace || ', ' || startTime || '</div></div>'
    || '<div class="parameters__item"><span class="parameters__title">Startovné na místě</span><span class="parameters__value">' || feeOnSite || '</span></div>'
    || '<a class="race-social-links__item--web" href="https://web.cz/">w</a></body></html>' END AS html
FROM ({T.RAW}) r"""


def detail_pages(spark, sf, source):
    return T.view(spark, sf, DETAIL).filter(F.col("source") == source)


def _cell(x):
    return D.trim(x)


@query("page_label_values", f"""WITH d AS ({T.text(DETAIL)}),
a AS (SELECT page_id, unnest([{{'l': 'den', 'v': {_cell('date')}}}, {{'l': 'místo', 'v': {_cell("city || ', okres Okres, kraj ' || region")}}}, {{'l': 'neznámé', 'v': '?'}},
  {{'l': 'povrch', 'v': {_cell('surface')}}}, {{'l': 'poháry', 'v': {_cell('cup')}}}, {{'l': 'webové stránky', 'v': 'https://listing.example/go/1'}}]) AS p FROM d WHERE source = 'behej'),
b AS (SELECT page_id, unnest([{{'l': 'date', 'v': {_cell('date')}}}, {{'l': 'startTime', 'v': {_cell("'Start: ' || startTime")}}}, {{'l': 'location', 'v': {_cell("city || ', hala, Kraj: ' || region")}}},
  {{'l': 'distance', 'v': {_cell("'Délka tratí: ' || distance")}}}, {{'l': 'raceType', 'v': {_cell("'Typ závodu: ' || surface")}}}, {{'l': 'organizer', 'v': {_cell("contact || ' klub'")}}},
  {{'l': 'organizerWeb', 'v': 'https://klub.cz/x'}}]) AS p FROM d WHERE source = 'ceskybeh'),
c AS (SELECT page_id, unnest([{{'l': 'datum konání', 'v': {_cell('date')}}}, {{'l': 'místo a čas startu', 'v': {_cell("startPlace || ', ' || startTime")}}}, {{'l': 'startovné na místě', 'v': {_cell('feeOnSite')}}}]) AS p FROM d WHERE source = 'svetbehu')
SELECT page_id, p.l AS label, p.v AS value FROM (FROM a UNION ALL FROM b UNION ALL FROM c) WHERE p.v <> ''""")
def page_label_values(spark, sf):
    """Label and value pairs of all three layouts."""
    out = None
    for source, pairs in (("behej", G.table_pairs(F.col("html"), F.col("url"))), ("ceskybeh", G.icon_pairs(F.col("html"))), ("svetbehu", G.term_pairs(F.col("html")))):
        part = G.label_values(detail_pages(spark, sf, source), pairs).select("page_id", "label", "value")
        out = part if out is None else out.unionByName(part)
    return out


@query("label_pivot", f"""WITH d AS ({T.text(DETAIL)}) SELECT page_id, source, {D.trim('title')} AS title,
  CASE source WHEN 'behej' THEN {_cell('surface')} WHEN 'ceskybeh' THEN {_cell('surface')} ELSE '' END AS surface,
  CASE source WHEN 'behej' THEN {D.trim("string_split(city || ',', ',')[1]")} WHEN 'ceskybeh' THEN CASE WHEN city = '' THEN 'hala' ELSE {D.trim('city')} END ELSE '' END AS city,
  CASE source WHEN 'svetbehu' THEN '' ELSE {D.trim('region')} END AS region,
  CASE source WHEN 'behej' THEN 'https://listing.example/go/1' WHEN 'ceskybeh' THEN 'https://klub.cz/x' ELSE 'https://web.cz/' END AS website,
  CASE source WHEN 'svetbehu' THEN {D.trim('feeOnSite')} ELSE '' END AS feeOnSite FROM d""")
def label_pivot(spark, sf):
    """Labels to fields, last value wins, for all three layouts."""
    parts = [
        G.listings_from_table_pages(detail_pages(spark, sf, "behej")),
        G.listings_from_icon_pages(detail_pages(spark, sf, "ceskybeh")),
        G.listings_from_term_pages(detail_pages(spark, sf, "svetbehu")),
    ]
    return S.union_sources(*parts).select("page_id", "source", "title", "surface", "city", "region", "website", "feeOnSite")


# --- Streams -----------------------------------------------------------------

MICRO_BATCHES = 3


def _stream_of(spark, rows, order):
    """The rows as a stream of three files, each the next stretch of ``order``, read one a micro-batch."""
    path = scratch_path(spark, "arrivals")
    rows = stage(rows, "arriving")
    cuts = rows.select(F.percentile_approx(order, [k / MICRO_BATCHES for k in range(1, MICRO_BATCHES)], 10_000)).first()[0]
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if low is None else rows.filter(F.col(order) > F.lit(low))
        part = part if high is None else part.filter((F.col(order) <= F.lit(high)) | F.col(order).isNull())
        part.repartition(1).write.mode("append").parquet(path)  # a file each, its rows computed by as many tasks as before
    return W.folder_stream(spark, rows.schema, path, maxFilesPerTrigger=1)


def _events_stream(spark, sf, sql):
    """The events as they arrive, in the shape of one of the views."""
    return spark.sql(sql, events=_stream_of(spark, load(spark, sf, "events"), "ts"))


@query("stream_upsert", _UPSERT + " SELECT slug, name, cover_url, race_no, city, official_url FROM step2")
def stream_upsert(spark, sf):
    """The batch of the upsert in three micro-batches, onto a table kept in buckets."""
    old = T.view(spark, sf, OLD)
    table = W.RaceTable(spark, scratch_path(spark, "races"), old.schema, buckets=8)
    table.create(old)
    new = T.view(spark, sf, NEW).withColumn("arrival", F.pmod(F.xxhash64("slug"), F.lit(1000)))
    out, checkpoint = W.stream_paths(spark, "upsert")
    W.drain_batches(_stream_of(spark, new, "arrival").drop("arrival"), lambda batch, n: table.upsert(batch, n, T.AS_OF), checkpoint)
    return table.read(MICRO_BATCHES - 1).select("slug", "name", "cover_url", "race_no", "city", "official_url")


@query("stream_ingest", D.from_items("SELECT source, terrain, count(*) AS n, CAST(sum(len(distances)) AS BIGINT) AS distances, CAST(sum(priceFrom) AS BIGINT) AS fees FROM items GROUP BY 1, 2"))
def stream_ingest(spark, sf):
    """Listings written to the dataset folders, read back as a file stream and normalised."""
    from paceline import fixed_values as V
    root = scratch_path(spark, "datasets")
    raw = T.raw_listings(spark, sf)
    for folder, source in V.SOURCE_DIRS.items():
        raw.filter(F.col("source") == source).select(*V.RAW_FIELDS).write.json(f"{root}/{folder}/{V.DATASET_SUBDIR}")
    out, checkpoint = W.stream_paths(spark, "ingest")
    rows = W.drain(W.ingest_stream(spark, root, multi_line=False, maxFilesPerTrigger=12), out, checkpoint)
    return rows.groupBy("source", "terrain").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("distances")).alias("distances"), F.sum("priceFrom").alias("fees"))


_THROTTLED = f"""WITH RECURSIVE {REPORTS},
t AS (SELECT race_id, id, created_at FROM reports),
w AS (SELECT race_id, min(created_at) AS t0 FROM t GROUP BY 1
  UNION ALL SELECT race_id, nxt FROM (SELECT w.race_id, (SELECT min(t.created_at) FROM t WHERE t.race_id = w.race_id AND t.created_at >= w.t0 + INTERVAL 60 SECONDS) AS nxt FROM w) q WHERE nxt IS NOT NULL)
SELECT race_id AS key, min(id) AS id FROM w JOIN t USING (race_id) WHERE t.created_at = w.t0 GROUP BY race_id, t0"""


def _accepted(rows):
    """Accepted reports by key and id; of several at one time the smallest id."""
    return rows.select("key", "id")


@query("throttle_reports", _THROTTLED)
def throttle_reports(spark, sf):
    return _accepted(throttle(reports(spark, sf)))


@query("stream_throttle", _THROTTLED)
def stream_throttle(spark, sf):
    out, checkpoint = W.stream_paths(spark, "throttle")
    accepted = W.drain(W.throttle_stream(_events_stream(spark, sf, T.REPORTS)), out, checkpoint)
    return _accepted(accepted)


# Reports of missing races, throttled by the sender's address.
MISSING = "SELECT event_id AS id, concat('10.0.0.', CAST(user_id % 7 AS STRING)) AS address, CAST(ts AS TIMESTAMP) AS created_at FROM {events}"
_THROTTLED_MISSING = _THROTTLED.replace(REPORTS, f"reports AS ({T.text(MISSING)})").replace("race_id", "address")


@query("throttle_missing_reports", _THROTTLED_MISSING)
def throttle_missing_reports(spark, sf):
    return _accepted(throttle(T.view(spark, sf, MISSING), "address"))


@query("stream_throttle_missing", _THROTTLED_MISSING)
def stream_throttle_missing(spark, sf):
    out, checkpoint = W.stream_paths(spark, "throttle-missing")
    return _accepted(W.drain(W.throttle_stream(_events_stream(spark, sf, MISSING), "address"), out, checkpoint))


@query("stream_interest_counts", f"WITH {INTEREST} SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, race_id, count(*) AS n FROM interest GROUP BY 1, 2")
def stream_interest_counts(spark, sf):
    out, checkpoint = W.stream_paths(spark, "counts")
    counts = W.latest_counts(W.interest_counts_stream(_events_stream(spark, sf, T.INTEREST_NARROW)), spark, out, checkpoint)
    return counts.select(F.col("start").cast("date").cast("string").alias("day"), "race_id", "n")


@query("stream_unique_interest", f"WITH {INTEREST}, {_ONCE} SELECT user_id, race_id, count(*) AS n FROM once GROUP BY 1, 2")
def stream_unique_interest(spark, sf):
    W.keep_state_by_key(spark)
    out, checkpoint = W.stream_paths(spark, "unique")
    once = W.drain(W.unique_interest_stream(_events_stream(spark, sf, T.INTEREST_NARROW), None), out, checkpoint)
    return once.groupBy("user_id", "race_id").agg(F.count(F.lit(1)).alias("n"))
