"""Views of the driver tables in the shapes the operators work on.

Each view is one SQL text that Spark and DuckDB read alike (``{orders}`` etc.
stand for the tables), so a query and its oracle start from the same rows.
All of them are row-wise over the large table; none takes a subset.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline import fixed_values as V
from paceline.catalog.registry import load
from paceline.functions.parse import DISTANCES

AS_OF = "1998-06-15"
NBSP = chr(0xA0)


def _case(key: str, values: list[str], other: str = "") -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} {arms} ELSE '{other}' END"


CITIES = [
    "Praha", "Brno", "Ostrava", "Plzeň", "Liberec", "Olomouc", "České Budějovice", "Hradec Králové",
    "Pardubice", "Zlín", "Jihlava", "Kladno", "Opava", "Frýdek-Místek", "Karviná", "Třebíč", "Prostějov",
    "Příbram", "Bedřichov", "Radonice (Praha - východ)", "Praha 6", "Areál Vesec",
    "Lipno - Frymburk - Horní Planá", "Brno venkov", "",
]
REGION_TEXTS = [
    "Hlavní město Praha", "Jihomoravský kraj", "Moravskoslezský", "plzeňský kraj", "Liberecký", "Olomouc",
    "Jihočeský kraj", "Královéhradecký", "Pardubický kraj", "Zlínský", "Vysočina", "Středočeský kraj",
    "moravskoslezský kraj", "Moravskoslezský kraj", "Moravskoslezský", "Vysočina", "Olomoucký kraj",
    "Středočeský", "Liberecký kraj", "praha", "Praha", "neznámý kraj", "Jihočeský", "Jihomoravský", "Slovensko",
]
SURFACES = ["silnice", "silnice/asfalt, terén", "", "OCR závod", "Trail", "kros", "dráha", "smíšený", "štafeta", "jiný", "louka"]
DISTANCE_TEXTS = [
    "''", "'8,8 km'", "CAST(k % 40 + 2 AS STRING) || ' km / 5 km'", "'5/12/30/21,1 km'", "'60 minut'",
    "'štafeta 4x' || CAST(k % 9 + 1 AS STRING)", "'3 míle / 10 km +'", "CAST(k % 97 AS STRING) || ' km / 10 km / 10,05 km'",
    "'Maraton 42,195 km'", "'800 m'", "CAST(k % 30 + 1 AS STRING) || '.4 km/' || CAST(k % 30 + 1 AS STRING) || ',7 km okruh'",
]
FEES = ["''", "'zdarma'", "CAST(price % 900 + 100 AS STRING) || ',-'",
        "'1' || '" + NBSP + "' || CAST(price % 900 + 100 AS STRING) || ' Kč'", "'dobrovolné'", "'dle kategorie'"]
TIMES = ["10.30", "00:00", "25:10", "start v 9:05", "", "17:30 a 18:00", "8.15"]


def _expr_case(key: str, exprs: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(exprs)) + " ELSE '' END"


_MONTH = _case("m", [""] + list(V.MONTHS_GENITIVE))

RAW = f"""
SELECT CAST(k % 3 AS BIGINT) * 1000000000000 + k AS ord,
  {_case("k % 3", list(V.SOURCE_DIRS.values()))} AS source,
  'https://listing.example/' || CAST(k AS STRING) AS url,
  CASE seg WHEN 'MACHINERY' THEN 'Jarní běh' WHEN 'BUILDING' THEN 'Noční trail běh'
       WHEN 'AUTOMOBILE' THEN 'Městský půlmaraton' WHEN 'FURNITURE' THEN ' Maraton ' ELSE 'Běh naděje' END
    || CASE pr WHEN '1-URGENT' THEN ' okolo hradu' WHEN '2-HIGH' THEN ' kolem Přehrady'
       WHEN '3-MEDIUM' THEN '' WHEN '5-LOW' THEN ' – okolo hradu (noc)' ELSE ' městem' END
    || CASE WHEN k % 5 = 0 THEN ' ' || CAST(k % 3 + 1 AS STRING) || '. ročník' ELSE '' END AS title,
  CASE WHEN k % 97 = 0 THEN 'neznámo'
       WHEN k % 3 = 0 THEN CAST(d AS STRING) || '. ' || CAST(m AS STRING) || '.{NBSP}' || CAST(y AS STRING)
       WHEN k % 3 = 1 THEN CAST(y AS STRING) || '-' || lpad(CAST(m AS STRING), 2, '0') || '-' || lpad(CAST(d AS STRING), 2, '0')
       ELSE CAST(d AS STRING) || '. ' || {_MONTH} || ' ' || CAST(y AS STRING)
            || CASE WHEN k % 2 = 0 THEN ' – ' || CAST(d + 1 AS STRING) || '. ' || {_MONTH} || ' ' || CAST(y AS STRING) ELSE '' END
  END AS date,
  {_case("nk", CITIES)} || CASE WHEN k % 7 = 0 AND nk < 24 THEN ' (hala)' ELSE '' END AS city,
  CASE WHEN k % 2 = 0 THEN 'okres' ELSE '' END AS district,
  {_case("nk", REGION_TEXTS)} AS region,
  {_expr_case("k % 11", DISTANCE_TEXTS)} AS distance,
  {_case("(k + ck) % 11", SURFACES)} AS surface,
  CASE WHEN k % 4 = 0 THEN 'Krajský pohár' ELSE '' END AS cup,
  {_case("k % 7", TIMES)} AS startTime,
  CASE WHEN k % 3 = 0 THEN 'náměstí' ELSE ' ' END AS startPlace,
  '' AS registrationTime,
  CASE WHEN k % 3 = 1 THEN 'radnice' ELSE '' END AS registrationPlace,
  CASE WHEN k % 4 = 1 THEN 'Trať vede okolo ' || CAST(ck % 100 AS STRING) || ' rybníků' WHEN k % 4 = 2 THEN 'Okruh' ELSE '' END AS description,
  CASE WHEN k % 2 = 0 THEN ''
       WHEN k % 4 = 1 THEN 'https://www.serie' || CAST(ck % 7 AS STRING) || '.cz/'
       WHEN k % 8 = 3 THEN 'HTTPBEZ' || CAST(k AS STRING) || '.cz'
       ELSE 'http://Zavod' || CAST(k - k % 16 AS STRING) || '.CZ:80/' || CAST(y AS STRING) || '//' END AS website,
  CASE WHEN k % 3 = 0 THEN 'Jméno: Organizátor ' || CAST(ck % 50 AS STRING) || ' ' WHEN k % 3 = 1 THEN 'jan' || CAST(ck AS STRING) || '@klub.cz, tel. 777 123 ' || lpad(CAST(k % 1000 AS STRING), 3, '0') ELSE '' END AS contact,
  '' AS facebook, '' AS photos,
  CASE WHEN k % 6 = 0 THEN 'medaile' ELSE '' END AS rewards,
  CAST(k % 40 AS STRING) AS edition,
  {_expr_case("k % 6", FEES)} AS feeOnSite,
  {_expr_case("(k + 2) % 6", FEES)} AS feePreRegistration
FROM (SELECT o_orderkey AS k, o_custkey AS ck, c_nationkey AS nk, c_mktsegment AS seg, o_orderpriority AS pr,
        CAST(floor(o_totalprice) AS BIGINT) AS price, year(o_orderdate) AS y, month(o_orderdate) AS m,
        (day(o_orderdate) % 4) * 7 + 1 AS d
      FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey) base
"""

# Race rows typed directly, for search and reporting.  km1/km2 become `distances` in Spark.
RACES = f"""
SELECT k AS race_id, 'zavod-' || CAST(k AS STRING) AS slug,
  CASE seg WHEN 'MACHINERY' THEN 'Jarní běh' WHEN 'BUILDING' THEN 'Noční trail' WHEN 'AUTOMOBILE' THEN 'Městský půlmaraton'
       WHEN 'FURNITURE' THEN 'Maraton' ELSE 'Běh naděje' END || ' ' || city || CASE WHEN k % 10 = 0 THEN ' Maraton Praha' ELSE '' END AS name,
  CASE WHEN k % 3 = 0 THEN 'Popis trati' WHEN k % 3 = 1 THEN '  ' END AS description,
  od AS date_start,
  CASE WHEN k % 4 < 2 THEN '09:30' END AS time_start,
  city,
  CASE WHEN k % 9 = 0 THEN NULL ELSE region END AS region,
  CASE WHEN k % 50 = 0 THEN 'SK' ELSE 'CZ' END AS country,
  CASE WHEN k % 4 > 0 THEN CAST(48.5 + nk * 0.1 + (k % 37) * 0.01 AS DOUBLE) END AS lat,
  CASE WHEN k % 4 > 0 THEN CAST(12.5 + nk * 0.2 + (k % 41) * 0.01 AS DOUBLE) END AS lng,
  CASE WHEN k % 6 > 0 THEN CAST(k % 60 + 1 AS DOUBLE) + 0.1 END AS km1,
  CASE WHEN k % 6 > 1 THEN CAST(k % 13 AS DOUBLE) / 4 + 0.5 END AS km2,
  {_case("(k + ck) % 6", ["road", "trail", "cross", "obstacle", "mixed"], "ultra")} AS terrain,
  CASE WHEN k % 5 = 0 THEN CAST(k % 900 AS BIGINT) END AS elevation_gain,
  CASE WHEN k % 4 > 0 THEN CAST((k % 5) * 100 AS BIGINT) END AS price_from,
  CASE WHEN k % 8 > 2 THEN CAST((k % 5) * 150 AS BIGINT) END AS price_to,
  CASE WHEN k % 3 > 0 THEN 'https://zavod' || CAST(k % 4000 AS STRING) || '.cz' END AS website,
  CASE WHEN k % 3 > 0 AND k % 11 > 0 THEN 'https://zavod' || CAST(k - k % 100 AS STRING) || '.cz' END AS official_url,
  CASE WHEN k % 7 = 0 THEN 'https://prihlasky.cz' END AS registration_url,
  CASE WHEN k % 13 = 0 THEN 'cover' END AS cover_url,
  CASE WHEN k % 2 = 0 THEN 'Klub' END AS organizer,
  CASE WHEN k % 10 = 3 THEN CAST(k % 500 AS BIGINT) END AS capacity,
  {_case("k % 20", ["tentative", "cancelled"], "confirmed")} AS status,
  {_case("(k + 1) % 12", ["pending", "failed", "stale", "no_url", "complete"], "extracted")} AS extraction_status,
  CASE k % 4 WHEN 0 THEN 'behej' WHEN 1 THEN 'behej,ceskybeh' WHEN 2 THEN 'svetbehu' ELSE 'behej,ceskybeh,svetbehu' END AS source
FROM (SELECT o_orderkey AS k, o_custkey AS ck, c_nationkey AS nk, c_mktsegment AS seg, CAST(o_orderdate AS DATE) AS od,
        {_case("c_nationkey", CITIES[:19] + ["Radonice", "Šumperk", "Vesec", "Lipno", "Brno", "Vrchlabí"])} AS city,
        {_case("c_nationkey", ["Praha", "Jihomoravský", "Moravskoslezský", "Plzeňský", "Liberecký", "Olomoucký", "Jihočeský", "Královéhradecký", "Pardubický", "Zlínský", "Vysočina", "Středočeský", "Moravskoslezský", "Moravskoslezský", "Moravskoslezský", "Vysočina", "Olomoucký", "Středočeský", "Liberecký", "Středočeský", "Olomoucký", "Liberecký", "Jihočeský", "Jihomoravský", "Královéhradecký"])} AS region
      FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey) base
"""

# One search text per order.
SEARCHES = f"""
SELECT k AS query_id,
  trim({_case("k % 9", ["trail ", "cross ", "obstacle ", "road ", "ultra ", "Spartan ", "přespolní ", "závod "], "")}
  || {_case("(k + nk) % 8", ["10 km ", "5k ", "půlmaraton ", "maraton ", "desítka ", "21,1 km ", ""], "Jizerská ")}
  || {_case("ck % 7", ["v okolí ", "okolo ", "blízko ", "nedaleko ", "v ", "", "ve městě "])}
  || {_case("nk", ["Praze", "Brna", "Ostravě", "Plzně", "Liberce", "Olomouci", "Českých Budějovic", "Hradci Králové", "Pardubicích", "Zlíně", "Jihlavy", "Kladna", "Opavy", "Frýdku-Místku", "Karviné", "Třebíči", "Prostějova", "Příbrami", "Karlových Varech", "Ústí nad Labem", "Šumavě", "praha", "BRNO", "Telči"], "")}
  || {_case("(k + ck) % 13", [" v lednu", " v únoru", " března", " duben", " květen 2026", " cervna", " července", " v srpnu", " září", " zari", " listopad"], "")}) AS q
FROM (SELECT o_orderkey AS k, o_custkey AS ck, c_nationkey AS nk FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey) base
"""

# Interest, referrals and reports from the event stream.
INTEREST = """
SELECT event_id AS id, event_id * 2 AS race_id,
  CASE WHEN event_type = 'view' THEN NULL ELSE user_id % 40 END AS user_id,
  CASE WHEN event_type = 'signup' THEN (user_id + 7) % 150 END AS referred_by,
  CAST(ts AS TIMESTAMP) AS created_at
FROM {events}
"""
INTEREST_NARROW = INTEREST.replace("event_id * 2 AS race_id", "event_id % 97 AS race_id")
REFERRALS = """
SELECT event_id AS id, (user_id + 7) % 150 AS referrer_id, user_id AS referred_id, event_id % 20000 AS race_id, CAST(ts AS TIMESTAMP) AS created_at
FROM {events} WHERE event_type = 'signup'
"""
REPORTS = """
SELECT event_id AS id, user_id % 5 AS race_id,
  CASE WHEN event_id % 3 = 0 THEN 'datum,trať' WHEN event_id % 3 = 1 THEN '' ELSE 'jiné' END AS reasons,
  CASE WHEN event_id % 4 = 0 THEN 'zpráva' WHEN event_id % 4 = 1 THEN '' END AS message,
  event_id % 5 = 0 AS resolved, CAST(ts AS TIMESTAMP) AS created_at
FROM {events}
"""


def tables_in(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the parquet tables, as a DataFrame."""
    return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in tables_in(sql)})


def text(sql: str) -> str:
    """The same SQL with table names filled in, as a subquery for DuckDB."""
    return sql.format(**{t: t for t in tables_in(sql)})


def raw_listings(spark, sf_dir):
    return view(spark, sf_dir, RAW)


def races(spark, sf_dir) -> DataFrame:
    """Race rows with the nested distances; an entry without km is left out."""
    entries = F.array(
        F.struct(F.lit("hlavní").alias("label"), F.col("km1").alias("km")),
        F.struct(F.lit("krátká").alias("label"), F.col("km2").alias("km")),
    ).cast(DISTANCES)
    return view(spark, sf_dir, RACES).withColumn("distances", F.filter(entries, lambda d: d["km"].isNotNull())).drop("km1", "km2")


def searches(spark, sf_dir):
    return view(spark, sf_dir, SEARCHES)
