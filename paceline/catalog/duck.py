"""DuckDB wording of the field rules, for the oracles only."""

from __future__ import annotations

from paceline import fixed_values as V
from paceline.catalog import tables as T

B = r"[\s\x{00a0}]"


def trim(x):
    return rf"regexp_replace({x}, '^{B}+|{B}+$', '', 'g')"


def blank(x):
    return f"(coalesce({trim(x)}, '') = '')"


def norm(x):
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"


def czech(x):
    return f"lower(translate({x}, '{V.CZECH_FROM}', '{V.CZECH_TO}'))"


def tokens(x, least=2):
    return f"list_filter(string_split({x}, ' '), lambda w: length(w) >= {least})"


def token_set(x):
    return f"list_sort(list_distinct({tokens(x)}))"


def inter(a, b):
    return f"len(list_intersect({a}, {b}))"


def jaccard(a, b):
    return (f"(CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE CAST({inter(a, b)} AS DOUBLE) / "
            f"(len({a}) + len({b}) - {inter(a, b)}) END)")


def overlap(a, b):
    return f"(len({a}) = 0 OR len({b}) = 0 OR {inter(a, b)} > 0)"


def lookup(table, key):
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"(CASE {key} {arms} END)"


def start_of(x):
    return trim(rf"regexp_replace({trim(x)}, '{B}*[–—]{B}*[0-9].*$', '')")


def dotted(x):
    dense = f"regexp_replace({x}, '{B}', '', 'g')"
    p = f"string_split({dense}, '.')"
    return (rf"(CASE WHEN regexp_full_match({dense}, '[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}}') "
            f"THEN {p}[3] || '-' || lpad({p}[2], 2, '0') || '-' || lpad({p}[1], 2, '0') END)")


def month_no(x):
    names = ", ".join(f"'{m}'" for m in V.MONTHS_GENITIVE)
    return f"list_position([{names}], lower({x}))"


def worded(x, word=r"[^\s\x{00a0}]+", whole=True):
    a, z = ("^", "$") if whole else ("", "")
    shape = rf"{a}([0-9]{{1,2}})\.{B}*({word}){B}+([0-9]{{4}}){z}"
    g = [f"regexp_extract({x}, '{shape}', {i})" for i in (1, 2, 3)]
    return (f"(CASE WHEN {month_no(g[1])} > 0 THEN {g[2]} || '-' || lpad(CAST({month_no(g[1])} AS VARCHAR), 2, '0') "
            f"|| '-' || lpad({g[0]}, 2, '0') END)")


def date(x):
    s = start_of(x)
    return (f"coalesce(CASE WHEN regexp_full_match({s}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN {s} END, "
            f"{dotted(s)}, {worded(s)})")


def distances(x):
    """List of {label, km}, longest first."""
    seg = rf"string_split(regexp_replace({x}, '{B}*/{B}*([0-9])', chr(1) || '\1', 'g'), chr(1))"
    use = (f"list_filter(list_transform({seg}, lambda s: {trim('s')}), lambda s: s <> '' AND NOT regexp_matches(s, '(?i)minut|hodin|hod\\b') "
           f"AND (NOT regexp_matches(s, '(?i)štafet') OR regexp_matches(s, '(?i)km')))")
    shape = r"(?i)([0-9]+[.,]?[0-9]*)" + B + "*(km|míle|mil)?"
    num = f"TRY_CAST(replace(regexp_extract(s, '{shape}', 1), ',', '.') AS DOUBLE)"
    unit = f"lower(regexp_extract(s, '{shape}', 2))"
    km = f"(CASE WHEN {unit} IN ('míle', 'mil') THEN floor({num} * 1.609::DOUBLE * 10 + 0.5) / 10 ELSE {num} END)"
    label = trim(rf"regexp_replace(s, '{B}*\+?{B}*$', '')")
    read = f"list_filter(list_transform({use}, lambda s: {{'label': {label}, 'km': {km}}}), lambda d: d.km > 0)"
    one = f"list_transform({read}, lambda d: [{{'label': d.label, 'km': floor(d.km * 100 + 0.5) / 100}}])"
    return by_km(greedy(one, "abs(e.km - d[1].km) < 0.1::DOUBLE", "acc"))


def greedy(lists, near, when_near):
    """Fold one-element lists, adding an element unless something kept is near."""
    return (f"(CASE WHEN len({lists}) = 0 THEN [] ELSE list_reduce({lists}, lambda acc, d: "
            f"CASE WHEN len(list_filter(acc, lambda e: {near})) > 0 THEN {when_near} ELSE list_concat(acc, d) END) END)")


def by_km(x):
    keyed = f"list_reverse_sort(list_transform({x}, lambda q: {{'km': q.km, 'label': q.label}}))"
    return f"list_transform({keyed}, lambda q: {{'label': q.label, 'km': q.km}})"


def show(x):
    return f"array_to_string(list_transform({x}, lambda q: q.label || '=' || CAST(q.km AS VARCHAR)), ' | ')"


def terrain(x):
    arms = " ".join(f"WHEN regexp_matches({x}, '(?i){w}') THEN '{t}'" for w, t in V.TERRAIN_KEYWORDS)
    return (f"(CASE WHEN {blank(x)} THEN 'road' WHEN regexp_matches({x}, '(?i)silnic|asfalt') AND regexp_matches({x}, '(?i)terén') "
            f"THEN 'mixed' {arms} ELSE 'road' END)")


def clock(x):
    # the first H.MM not followed by a third digit becomes H:MM
    fixed = rf"regexp_replace({x}, '([0-9]{{1,2}})\.([0-9]{{2}})([^0-9]|$)', '\1:\2\3')"
    t = f"lpad(regexp_extract({fixed}, '[0-9]{{1,2}}:[0-9]{{2}}'), 5, '0')"
    return f"(CASE WHEN regexp_full_match({t}, '([01][0-9]|2[0-3]):[0-5][0-9]') AND {t} <> '00:00' THEN {t} END)"


def city(x):
    a = trim(rf"regexp_replace({trim(x)}, '{B}*\([^)]*\){B}*', ' ', 'g')")
    b = trim(f"regexp_replace({a}, '(?i){V.VENUE_PREFIX.replace(chr(92) + 's', B)}', '')")
    parts = f"regexp_split_to_array({b}, '{B}*-{B}*')"
    c = f"(CASE WHEN len({parts}) >= 3 AND len(list_filter({parts}, lambda p: length(p) >= 20)) = 0 THEN {parts}[1] ELSE {b} END)"
    return trim(rf"regexp_replace({c}, '(?i)^(Praha){B}+[0-9]+$', '\1')")


def region(x):
    return lookup(V.REGIONS, f"lower({trim(x)})")


def foreign(x):
    names = ", ".join(f"'{r}'" for r in V.FOREIGN_REGIONS)
    return f"(lower({trim(x)}) IN ({names}))"


def website(x):
    """Enough of the URL rules for the view's plain ASCII addresses."""
    full = f"(CASE WHEN starts_with({trim(x)}, 'http') THEN {trim(x)} ELSE 'https://' || {trim(x)} END)"
    shape = "^([a-z]+)://([^/]*)(.*)$"
    scheme, host, path = (f"regexp_extract({full}, '{shape}', {i})" for i in (1, 2, 3))
    port = f"(CASE {scheme} WHEN 'http' THEN ':80' ELSE ':443' END)"
    clean = f"(CASE WHEN ends_with({host}, {port}) THEN left({host}, length({host}) - length({port})) ELSE {host} END)"
    return f"(CASE WHEN NOT {blank(x)} THEN regexp_replace({scheme} || '://' || lower({clean}) || {path}, '/+$', '') END)"


def url_key(x):
    return f"regexp_replace(regexp_replace(regexp_replace(lower({trim(x)}), '^https?://', ''), '^www\\.', ''), '/+$', '')"


def fee(x):
    free = " OR ".join(f"contains(lower({x}), '{w}')" for w in V.FREE_WORDS)
    digits = rf"regexp_replace(regexp_extract({x}, '([0-9][0-9\s\x{{00a0}}]*[0-9]|[0-9]+)', 1), '{B}', '', 'g')"
    return f"(CASE WHEN {free} THEN 0 ELSE TRY_CAST(NULLIF({digits}, '') AS BIGINT) END)"


def organizer(x):
    return f"NULLIF({trim(rf'''regexp_extract({x}, 'Jméno:{B}*([^\n]+)', 1)''')}, '')"


def slug(name, day):
    return f"(substr(replace({norm(name)}, ' ', '-'), 1, 80) || '-' || substr({day}, 1, 4))"


RAW = f"raw AS ({T.text(T.RAW)})"

ITEMS = f"""items0 AS (SELECT ord, source, {trim('title')} AS title, {date('date')} AS date, {city('city')} AS city,
  coalesce({region('region')}, '') AS region, {distances('distance')} AS distances, {terrain('surface')} AS terrain,
  {clock('startTime')} AS startTime, {website('website')} AS website,
  {fee('feePreRegistration')} AS pre, {fee('feeOnSite')} AS site, {trim('description')} AS description, {trim('contact')} AS contact,
  CASE WHEN {date('date')} IS NULL THEN 'bad_date' WHEN {foreign('region')} THEN 'foreign' END AS reject_reason FROM raw),
items AS (SELECT * EXCLUDE (pre, site), coalesce(pre, site) AS priceFrom, coalesce(site, pre) AS priceTo FROM items0 WHERE reject_reason IS NULL)"""

# Exact groups, then the greedy rule date by date: group after group joins its first matching leader.
GROUPS = f"""keyed AS (SELECT *, coalesce({url_key('website')}, '') AS uk, {norm('title')} AS nt, {norm('city')} AS nc FROM items),
exact AS (SELECT CASE WHEN uk <> '' THEN 1 ELSE 2 END AS phase, date, uk, CASE WHEN uk = '' THEN nt ELSE '' END AS gt,
    CASE WHEN uk = '' THEN nc ELSE '' END AS gc, min(ord) AS first_ord, count(*) AS n_rows FROM keyed GROUP BY ALL),
nodes AS (SELECT date, first_ord, {token_set('gt')} AS names, {token_set('gc')} AS cities,
    row_number() OVER (PARTITION BY date ORDER BY first_ord) AS rn FROM exact WHERE phase = 2),
walk AS (
  SELECT date, 1 AS rn, [{{'o': first_ord, 'n': names, 'c': cities}}] AS leaders, first_ord AS b, first_ord AS a FROM nodes WHERE rn = 1
  UNION ALL
  SELECT date, rn, CASE WHEN hit IS NULL THEN list_append(leaders, {{'o': first_ord, 'n': names, 'c': cities}}) ELSE leaders END,
    first_ord, coalesce(hit, first_ord)
  FROM (SELECT w.date, n.rn, w.leaders, n.first_ord, n.names, n.cities,
      list_filter(w.leaders, lambda l: {jaccard('l.n', 'n.names')} >= 0.6::DOUBLE AND {overlap('l.c', 'n.cities')})[1].o AS hit
    FROM walk w JOIN nodes n ON n.date = w.date AND n.rn = w.rn + 1) step),
ids AS (SELECT e.*, coalesce(w.a, e.first_ord) AS group_id FROM exact e LEFT JOIN walk w ON e.phase = 2 AND w.date = e.date AND w.b = e.first_ord),
member AS (SELECT k.*, i.phase, i.first_ord, i.group_id, row_number() OVER (PARTITION BY i.group_id ORDER BY i.first_ord, k.ord) AS pos
  FROM keyed k JOIN ids i ON k.date = i.date AND k.uk = i.uk AND (k.uk <> '' OR (k.nt = i.gt AND k.nc = i.gc)))"""

_JOINED = greedy("lst", "abs(e.km - d[1].km) < 0.5::DOUBLE", (
    "list_transform(acc, lambda k, i: CASE WHEN i = list_position(list_transform(acc, lambda e: abs(e.km - d[1].km) < 0.5::DOUBLE), true) "
    "AND length(d[1].label) > length(k.label) THEN {'label': d[1].label, 'km': k.km} ELSE k END)"))
MERGED = f"""ds AS (SELECT group_id, list([d] ORDER BY pos, idx) AS lst FROM
  (SELECT group_id, pos, unnest(distances) AS d, generate_subscripts(distances, 1) AS idx FROM member) u GROUP BY group_id),
merged AS (SELECT m.*, coalesce({by_km(_JOINED)}, []) AS distances FROM (
  SELECT group_id, phase, date AS date_start, count(*) AS n_rows,
    coalesce(arg_min(title, -length(title) * 1000000 + pos) FILTER (WHERE title <> ''), '') AS name,
    arg_min(description, -length(description) * 1000000 + pos) FILTER (WHERE description <> '') AS description,
    arg_min(startTime, pos) FILTER (WHERE startTime IS NOT NULL) AS time_start,
    coalesce(arg_min(city, length(city) * 1000000 + pos) FILTER (WHERE city <> ''), '') AS city,
    arg_min(region, pos) FILTER (WHERE region <> '') AS region,
    ['road', 'mixed', 'cross', 'trail', 'obstacle'][max(list_position(['road', 'mixed', 'cross', 'trail', 'obstacle'], terrain))] AS terrain,
    min(priceFrom) AS price_from, max(priceTo) AS price_to,
    arg_min(website, pos) FILTER (WHERE website IS NOT NULL) AS website,
    coalesce(arg_min({{'x': {organizer('contact')}}}, pos) FILTER (WHERE source = 'behej').x,
      arg_min({organizer('contact')}, pos) FILTER (WHERE {organizer('contact')} IS NOT NULL)) AS organizer,
    string_agg(DISTINCT source, ',' ORDER BY source) AS source
  FROM member GROUP BY group_id, phase, date) m LEFT JOIN ds USING (group_id))"""
FINAL = f"""shared AS (SELECT *, count(*) OVER (PARTITION BY website) AS same FROM merged),
final AS (SELECT *, CASE WHEN website IS NOT NULL AND same = 1 THEN website END AS official_url, {slug('name', 'date_start')} AS base FROM shared),
races AS (SELECT *, base || CASE WHEN row_number() OVER (PARTITION BY base ORDER BY phase, group_id) > 1
  THEN '-' || CAST(row_number() OVER (PARTITION BY base ORDER BY phase, group_id) AS VARCHAR) ELSE '' END AS slug FROM final)"""


def from_items(body):
    return f"WITH {RAW}, {ITEMS} {body}"


def from_groups(body):
    return f"WITH RECURSIVE {RAW}, {ITEMS}, {GROUPS} {body}"


def from_merged(body):
    return f"WITH RECURSIVE {RAW}, {ITEMS}, {GROUPS}, {MERGED} {body}"


def from_races(body):
    return f"WITH RECURSIVE {RAW}, {ITEMS}, {GROUPS}, {MERGED}, {FINAL} {body}"
