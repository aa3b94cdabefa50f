import datetime as dt

import pytest
from pyspark.sql import functions as F

from paceline.operators import filters as X
from paceline.operators.places import near_points
from paceline.plans import search as S
from paceline.sources.cities import city_dim

CASES = [
    ("trail závod", {"terrain": "trail"}),
    ("cross závod", {"terrain": "cross"}),
    ("obstacle race", {"terrain": "obstacle"}),
    ("road race", {"terrain": "road"}),
    ("ultra běh", {"terrain": None, "km": 50}),
    ("něco v lednu", {"month": 1}),
    ("závod v dubnu", {"month": 4}),
    ("běh v srpnu", {"month": 8}),
    ("závod v listopadu", {"month": 11}),
    ("závod v Praze", {"city": "Praha", "proximity": None}),
    ("běh v Brně", {"city": "Brno"}),
    ("závod Praha", {"city": "Praha"}),
    ("ultra Brno", {"city": "Brno", "km": 50, "terrain": None}),
    ("trail Ostrava", {"city": "Ostrava"}),
    ("Ultra v okolí Brna", {"city": "Brno", "km": 50, "terrain": None, "proximity": True, "search_text": None}),
    ("závod v okolí Prahy", {"city": "Praha"}),
    ("běh blízko Ostravy", {"city": "Ostrava"}),
    ("závod 10 km", {"km": 10}),
    ("běh na 5k", {"km": 5}),
    ("půlmaraton v Praze", {"km": 21}),
    ("maraton v Brně", {"km": 42}),
    ("desítka v Ostravě", {"km": 10}),
    ("pětka pro děti", {"km": 5}),
    ("půlmaraton", {"km": 21}),
    ("trail v praze", {"terrain": "trail", "city": "Praha", "search_text": None}),
    ("maraton v brně v dubnu", {"km": 42, "city": "Brno", "month": 4, "search_text": None}),
    ("jizerská trail", {"terrain": "trail", "search_text": "jizerska"}),
    ("trail blízko Prahy", {"terrain": "trail", "city": "Praha", "proximity": True, "search_text": None}),
    ("závod nedaleko Ostravy", {"city": "Ostrava", "proximity": True, "search_text": "zavod"}),
    ("závody okolo Brna", {"proximity": True}),
    ("trail poblíž Ostravy", {"proximity": True}),
    ("závody blízko Plzně", {"proximity": True}),
    ("nedaleko Liberce", {"proximity": True}),
    ("trail Brno", {"proximity": None}),
    ("závody okolo", {"proximity": None}),
    ("blízko něčeho", {"proximity": None}),
    ("běh v září", {"month": None}),
    ("21,1 km", {"km": 1}),
    ("maratonem", {"km": 42, "search_text": "em"}),
]


def test_parse_queries(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(CASES)], "id int, q string")
    rows = {r["id"]: r.asDict() for r in S.parse_queries(df).collect()}
    for i, (text, want) in enumerate(CASES):
        assert {k: rows[i][k] for k in want} == want, text


def test_folded_parse_sees_accented_months(spark):
    df = spark.createDataFrame([("běh v září",)], "q string")
    assert S.parse_queries(df, fold_accents=True).first()["month"] == 9


RACES = [
    ("ORLEN Maraton Praha 2026", "Praha", "Praha", [42.195], "road", "2026-05-03"),
    ("Juniorský Maraton - Praha a Středočeský kraj", "Praha", "Praha, Středočeský", [10.0], "road", "2026-04-22"),
    ("Pardubický půlmaraton", "Pardubice", "Pardubický", [21.1], "road", "2026-04-11"),
    ("Horský půlmaraton Sušice", "Sušice", "Plzeňský", [30.0, 21.1], "trail", "2026-04-11"),
    ("Trail půlmaraton Prahy", "Praha", "Praha", [21.1], "trail", "2026-04-14"),
    ("Urban Challenge Praha", "Praha", "Praha", [10.0], "road", "2026-04-16"),
    ("Jizerská 50 běh", "Bedřichov", "Liberecký", [50.0, 25.0], "trail", "2026-09-12"),
    ("Gladiator race Brno", "Brno", "Jihomoravský", [12.0, 6.0], "obstacle", "2026-06-14"),
    ("Vltava Run", "Praha", "Praha", [350.0, 200.0], "trail", "2026-08-10"),
    ("Brno City Run", "Brno", "Jihomoravský", [21.1, 10.0], "road", "2026-10-03"),
    ("Krajský půlmaraton", "Plzeň", "Plzeňský", [21.1, 9.99], "road", "2026-04-11"),
]


@pytest.fixture(scope="module")
def races(spark):
    rows = [
        (i, f"r{i:02d}", n, c, r, [("x", k) for k in km], t, dt.date.fromisoformat(d), "confirmed", "CZ", "extracted", None, None)
        for i, (n, c, r, km, t, d) in enumerate(RACES)
    ]
    return spark.createDataFrame(
        rows, "race_id long, slug string, name string, city string, region string, distances array<struct<label:string,km:double>>, "
              "terrain string, date_start date, status string, country string, extraction_status string, lat double, lng double").cache()


def ranked(races, query):
    return [r["name"] for r in S.rank_by_query(races, query).collect()]


def test_rank_phrase_first_and_all_words_needed(races):
    names = ranked(races, "Maraton Praha")
    assert names[0].startswith("ORLEN") and len(names) == 2
    assert not any("půlmaraton" in n for n in names)


def test_rank_words_cities_and_no_match(races):
    assert ranked(races.filter("name LIKE '%půlmaraton%'"), "maraton") == []
    assert ranked(races, "Jizerská") == ["Jizerská 50 běh"]
    assert set(ranked(races, "Brno")) == {"Gladiator race Brno", "Brno City Run"}
    assert ranked(races, "neexistující závod xyz") == []
    assert ranked(races, "Urban Challenge")[0] == "Urban Challenge Praha"
    assert "Vltava Run" not in ranked(races, "ultra Brno")
    assert {"Praha"} == {r["city"] for r in S.rank_by_query(races, "Praha").collect()}


def test_rank_empty_query_keeps_all_by_date(races):
    for query in ("", "   ", "x"):
        days = [r["date_start"] for r in S.rank_by_query(races, query).collect()]
        assert len(days) == len(RACES) and days == sorted(days)


def test_month_bounds():
    assert X.month_bounds(3, "1998-06-15") == (dt.date(1999, 3, 1), dt.date(1999, 3, 31))
    assert X.month_bounds(6, "1998-06-30") == (dt.date(1998, 6, 1), dt.date(1998, 6, 30))
    assert X.month_bounds(2, "2027-03-01") == (dt.date(2028, 2, 1), dt.date(2028, 2, 29))
    assert X.month_bounds(13, "1998-06-15") is None


def names(df):
    return {r["name"] for r in df.collect()}


def test_search_filters(spark, races):
    dim = city_dim(spark)

    def find(**params):
        return names(S.search_races(races, dim, "2026-04-12", **params))

    assert find(km=50) == {"Jizerská 50 běh", "Vltava Run"}
    assert find(month=4) == {"Juniorský Maraton - Praha a Středočeský kraj", "Trail půlmaraton Prahy", "Urban Challenge Praha"}
    assert find(month=99) == set()
    assert find(terrain="obstacle") == {"Gladiator race Brno"}
    assert find(city="b%rno") == {"Gladiator race Brno", "Brno City Run"}
    # rows without a point fall back to the region of the city
    assert find(city="Brno", proximity=True) == {"Gladiator race Brno", "Brno City Run"}
    assert find(city="Bedřichov", proximity=True) == {"Jizerská 50 běh"}
    assert find(city="jihomor", proximity=True) == {"Gladiator race Brno", "Brno City Run"}
    first = S.search_races(races, dim, "2026-04-12", search_text="jizerska").first()
    assert first["name"] == "Jizerská 50 běh" and first["score"] == 1.0


def test_distance_is_close_to_the_ellipsoid(spark):
    from paceline.functions.geo import distance_m

    df = spark.range(1).select(
        distance_m(F.lit(50.0755), F.lit(14.4378), F.lit(49.1951), F.lit(16.6068)).alias("d"),
        distance_m(F.lit(50.0), F.lit(14.0), F.lit(50.0), F.lit(14.0)).alias("zero"),
        distance_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("equator"))
    row = df.first()
    assert abs(row["equator"] - 111319.49) < 1 and row["zero"] == 0
    assert 184_000 < row["d"] < 186_000


def test_validate_filters(spark):
    df = spark.createDataFrame([
        ('{"terrain":"ultra","city":"B","month":13,"km":0,"proximity":false,"searchText":" a "}',),
        ('{"terrain":"road","city":"Brno","month":5,"km":10.5,"proximity":true}',), (None,)], "j string")
    got = [r["v"] for r in df.select(S.validate_filters(F.col("j")).alias("v")).collect()]
    assert tuple(got[0]) == (None, None, None, None, None, "a")
    assert tuple(got[1]) == ("road", "Brno", 5, 10.5, True, "")
    assert got[2] is None


def test_near_points_meet_across_the_date_line(spark):
    points = spark.createDataFrame([(1, 10.0, 179.95), (2, 10.0, -179.95), (3, 88.9, 0.0)], "point_id int, lat double, lng double")
    races = spark.createDataFrame([(7, 10.0, -179.95), (8, 10.0, 179.95), (9, 10.0, 0.0), (6, 88.9, 179.0)], "race_id int, lat double, lng double")
    got = {(r.point_id, r.race_id): r.dist_m for r in near_points(points, races).collect()}
    assert set(got) == {(1, 7), (1, 8), (2, 7), (2, 8)} and 10_000 < got[1, 7] < 12_000
    assert {(r.point_id, r.race_id) for r in near_points(points, races, 300_000).collect()} == {*got, (3, 6)}


def test_a_crowded_spot_is_cut_into_parts(spark, monkeypatch):
    from paceline.operators import places

    races = spark.range(400).select(F.col("id").alias("race_id"), F.when(F.col("id") < 350, 49.2).otherwise(49.2 + F.col("id") / 500).alias("lat"),
                                    F.lit(16.6).alias("lng"))
    points = spark.createDataFrame([(i, 49.2 + i / 100, 16.6) for i in range(12)], "point_id long, lat double, lng double")
    whole = sorted((r.point_id, r.race_id, round(r.dist_m, 3)) for r in places.near_points(points, races).collect())
    monkeypatch.setattr(places, "CELL_ROWS", 25)
    near = places.near_points(points, races)
    assert sorted((r.point_id, r.race_id, round(r.dist_m, 3)) for r in near.collect()) == whole and len(whole) > 4000


def test_search_by_queries_equals_one_search_each(spark):
    import random

    from paceline.plans.query_table import search_by_queries

    rng = random.Random(5)
    cities, names = ["Brno", "Praha", "Vesec", "Olomouc", "Nikde"], ["Noční trail", "Jarní běh", "Maraton", "Jizerská padesátka"]
    regions = {"Brno": "Jihomoravský", "Praha": "Praha", "Vesec": "Liberecký", "Olomouc": "Olomoucký", "Nikde": None}
    rows = []
    for i in range(120):
        city = rng.choice(cities)
        placed = city in ("Brno", "Vesec") and rng.random() < 0.7
        rows.append((i, f"z{i}", f"{rng.choice(names)} {rng.choice(['', city])}", city, regions[city], rng.choice(["trail", "road", None]),
                     dt.date(2026, rng.randint(1, 12), 3), [(None, float(rng.choice([5, 10, 21, 55])))], 49.2 + rng.random() if placed else None,
                     16.6 + rng.random() / 3 if placed else None, "confirmed" if i % 9 else "cancelled", "CZ", "extracted"))
    races = spark.createDataFrame(rows, "race_id long, slug string, name string, city string, region string, terrain string, date_start date, "
                                  "distances array<struct<label:string,km:double>>, lat double, lng double, status string, country string, extraction_status string")
    asked = [{}, {"terrain": "trail"}, {"month": 5, "km": 10.0}, {"month": 13}, {"city": "brno"}, {"city": "B%"}, {"city": "%"}, {"region": "Liberecký"},
             {"city": "Brno", "proximity": True, "terrain": "road"}, {"city": "Vesec", "proximity": True}, {"city": "morav", "proximity": True},
             {"search_text": "nocni trial"}, {"search_text": "jizerska", "terrain": "trail", "city": "Brno"}, {"search_text": "!!"},
             {"search_text": "beh", "city": "Vesec", "proximity": True}, {"km": 60.0, "search_text": ""}, {}]
    schema = "query_id int, terrain string, region string, month int, km double, city string, proximity boolean, search_text string"
    keys = [c.split()[0] for c in schema.split(", ")][1:]
    queries = spark.createDataFrame([(i, *[q.get(k) for k in keys]) for i, q in enumerate(asked)], schema)
    dim = city_dim(spark)
    got = {}
    for r in search_by_queries(queries, races, dim, "2026-04-10", limit=7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.race_id, round(r.score, 5))
    for i, q in enumerate(asked):
        found = S.search_races(races, dim, "2026-04-10", limit=7, **{k: v for k, v in q.items() if v is not None})
        want = [(r.race_id, round(r.score, 5)) for r in found.collect()]
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == want, q
    assert search_by_queries(queries.limit(0), races, dim, "2026-04-10").count() == 0


def test_patterns_are_tried_by_halves_and_the_first_wins(evaluate):
    from paceline import fixed_values as V
    from paceline.functions import text as T

    def one_by_one(patterns, matches):
        return lambda c: F.coalesce(*[F.when(matches(c, p), F.lit(v)) for p, v in patterns])

    texts = ("", None, "maraton pulku", "březnu lednu", "xlednu", "trail cross", "praha 5 brno", "petku desitka", "Října říjnu", "městsk road", "a_lednu", "\u017fpartan")
    for patterns, matches in ((V.QUERY_TERRAINS, T.like), (V.QUERY_MONTHS, T.like), (V.QUERY_CITIES, T.like_folded), (V.QUERY_KM_WORDS, T.like_folded)):
        assert evaluate(lambda c: S._first_of(c, patterns, matches), *texts) == evaluate(one_by_one(patterns, matches), *texts)  # noqa: B023
    assert S._any_of(V.QUERY_MONTHS[:2]) == r"\b(?:leden|lednu|ledna|unor|unora|únor|února)\b"


def test_search_by_queries_fetches_only_races_that_can_be_listed(spark, monkeypatch):
    from paceline.plans import query_table

    staged = {}

    def counted(df, label="stage", stage=query_table.stage):
        out = stage(df, label)
        staged[label] = out.count()
        return out

    names = [f"Noční trail {i % 8}" for i in range(8)] + ["Maraton"]
    rows = [(i, f"z{i:05d}", names[i % 9], "Brno" if i % 2 else "Vesec", "Jihomoravský" if i % 2 else None, "trail" if i % 3 else "road",
             dt.date(2026, 4, 1) + dt.timedelta(days=i * 7 % 300), [(None, float(i % 4 * 5 + 5))], 49.2 + i / 9000 if i % 5 else None, 16.6 if i % 5 else None,
             "confirmed", "CZ", "extracted") for i in range(4000)]
    races = spark.createDataFrame(rows, "race_id long, slug string, name string, city string, region string, terrain string, date_start date, "
                                  "distances array<struct<label:string,km:double>>, lat double, lng double, status string, country string, extraction_status string")
    asked = [{"search_text": "nocni trail 3"}, {"search_text": "maraton", "km": 10.0, "terrain": "trail"}, {"terrain": "road", "month": 6},
             {"city": "%", "proximity": True}, {"search_text": "trail", "city": "Brno", "proximity": True}]
    keys = ["terrain", "month", "km", "city", "proximity", "search_text"]
    queries = spark.createDataFrame([(i, *[q.get(k) for k in keys]) for i, q in enumerate(asked)],
                                    "query_id int, terrain string, month int, km double, city string, proximity boolean, search_text string")
    dim = city_dim(spark)
    monkeypatch.setattr(query_table, "stage", counted)
    got = {}
    for r in query_table.search_by_queries(queries, races, dim, "2026-04-10", limit=6, digits=5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.race_id, r.score)
    for i, q in enumerate(asked):
        want = [(r.race_id, round(r.score, 5)) for r in S.search_races(races, dim, "2026-04-10", limit=6, **q).collect()]
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == want and len(want) == 6, q
    assert staged["visible"] > 3500 and staged["heads"] < 300  # thousands pass the filters of each text


def test_small_letters_find_what_patterns_find_in_any_case(evaluate):
    from paceline import fixed_values as V
    from paceline.functions import text as T

    texts = ("TRAIL", "PŘESPOLNÍ x", "přespolnía", "xZÁŘÍy", "v ÚNORU", "aÚnoru", "ſpartan", "TERİN", "İTRAIL", "Kros", "KŘÍJEN říjen", "bŘeZnuı", None, "")
    for patterns in (V.QUERY_TERRAINS, V.QUERY_MONTHS, ((V.QUERY_ULTRA, 1),)):
        small = lambda c: S._first_of(T.small_letters(c), patterns, T.like_small)  # noqa: B023, E731
        assert evaluate(small, *texts) == evaluate(lambda c: S._first_of(c, patterns, T.like), *texts)  # noqa: B023
