import re
import unicodedata

from pyspark.sql import functions as F

from paceline.functions import labels as L
from paceline.functions import parse as P
from paceline.functions.hosts import ascii_host
from paceline.functions import text as T

NBSP = "\u00a0"


def test_normalize_text(evaluate):
    got = evaluate(T.normalize_text, "Půlmaraton České Budějovice", "Trail – Běh (2026)", "", "ß√ ǅ", "Å̊ x")
    assert got == ["pulmaraton ceske budejovice", "trail beh 2026", "", "", "a x"]


def test_normalize_text_matches_decomposition_everywhere(evaluate):
    import re

    rows, want = [], []
    for start in range(0x80, 0x3000, 64):
        text = "".join(f"a{chr(c)}b" for c in range(start, start + 64))
        plain = "".join(c for c in unicodedata.normalize("NFD", text) if not "\u0300" <= c <= "\u036f")
        rows.append(text)
        want.append(re.sub(r"[^a-z0-9]+", " ", plain.lower()).strip())
    got = evaluate(T.normalize_text, *rows)
    # Python and the JVM lower-case a handful of characters differently; folding must agree on all.
    assert sum(g != w for g, w in zip(got, want)) == 0


def test_normalize_text_is_idempotent(evaluate):
    once = evaluate(T.normalize_text, "Běh – 10 km!", "ÁČ", "x  y")
    assert evaluate(T.normalize_text, *once) == once


def test_normalize_czech(evaluate):
    assert evaluate(T.normalize_czech, "Žižkov – Běh!", None, "ÄÖü") == ["zizkov – beh!", None, "aou"]


def test_dates(evaluate):
    got = evaluate(
        P.normalize_date,
        "11. září 2026 – 12. září 2026", "06.06.2026–06.06.2026", "1. května 2026", " 2026-13-99 ",
        f"1.{NBSP}2.{NBSP}2026", "2026-04-10 – pozdě", "32. nic 2026", "", "10. 12. 2025", "1.1.2026—2.1.2026",
    )
    assert got == [
        "2026-09-11", "2026-06-06", "2026-05-01", "2026-13-99", "2026-02-01", None, None, None,
        "2025-12-10", "2026-01-01",
    ]


def test_extractor_date(evaluate):
    got = evaluate(
        P.extractor_date,
        ("1. 4. 2026", "behej"), ("10. dubna 2026 – 11. dubna 2026", "ceskybeh"), ("3. května 2026", "ceskybeh"),
        ("3. ledna 2026", "svetbehu"), ("9.9.2026", "svetbehu"),
    )
    assert got == ["2026-04-01", "2026-04-10", "3. května 2026", "3. ledna 2026", "2026-09-09"]


def test_distances(evaluate):
    got = evaluate(
        P.parse_distances,
        "8,8 km", "10 km / 5 km", "5/12/30/21,1 km", "60 minut / 10 km", "štafeta 4x5", "štafeta 4x5 km",
        "3 míle", "10 km / 10,05 km / 5 km+", "800 m", "", "0 km", "1.005 km", "hodinovka", "2 hod / 3",
    )
    flat = [[(d["label"], d["km"]) for d in row] for row in got]
    assert flat == [
        [("8,8 km", 8.8)],
        [("10 km", 10.0), ("5 km", 5.0)],
        [("30", 30.0), ("21,1 km", 21.1), ("12", 12.0), ("5", 5.0)],
        [("10 km", 10.0)],
        [],
        [("štafeta 4x5 km", 4.0)],
        [("3 míle", 4.8)],
        [("10 km", 10.0), ("5 km", 5.0)],
        [("800 m", 800.0)],
        [],
        [],
        [("1.005 km", 1.0)],
        [],
        [("3", 3.0)],
    ]


def test_terrain(evaluate):
    got = evaluate(
        P.surface_to_terrain, "silnice/asfalt, terén", "", "OCR závod", "PŘEKÁŽKY", "kros", "dráha", "jiný",
        "neznámý", f" {NBSP}", "TERÉN", "štafety",
    )
    assert got == ["mixed", "road", "obstacle", "obstacle", "trail", "road", "mixed", "road", "road", "trail", "mixed"]


def test_time(evaluate):
    got = evaluate(P.normalize_time, "10.30", "00:00", "25:10", "start 9:05 a 10:00", "", "12.345", "25:10 8:00", "0.15")
    assert got == ["10:30", None, None, "09:05", None, None, None, "00:15"]


def test_city(evaluate):
    got = evaluate(
        P.normalize_city, "Radonice (Praha - východ)", "Praha 6", "Frýdek-Místek", "Areál Vesec", "A-B-C",
        "Lipno - Frymburk - Horní Planá", f"a-b-{'c' * 25}", "PARK Brno", "",
    )
    assert got == ["Radonice", "Praha", "Frýdek-Místek", "Vesec", "A", "Lipno", f"a-b-{'c' * 25}", "Brno", ""]


def test_region(evaluate):
    assert evaluate(P.normalize_region, " Hlavní město Praha", "VYSOČINA", "jinde", "") == ["Praha", "Vysočina", None, None]
    assert evaluate(P.is_foreign_region, "Slovensko ", "praha", None) == [True, False, False]


def test_website(evaluate):
    got = evaluate(
        P.normalize_website,
        "www.Site.cz/", "HTTP.cz", "http://Abc.CZ:80/x/", "https://a.cz:8080", "https://a.cz?q=1", "not a url",
        "", "https://a.cz/ž b", "http://", "https://a.cz:99999/", "https://user:p@A.cz/x#Y", "httpfoo",
    )
    assert got == [
        "https://www.site.cz", "https://http.cz", "http://abc.cz/x", "https://a.cz:8080", "https://a.cz/?q=1", None,
        None, "https://a.cz/%C5%BE%20b", None, None, "https://user:p@a.cz/x#Y", None,
    ]


def test_website_resolves_dot_parts(evaluate):
    got = evaluate(P.normalize_website, "https://a.cz/a/../b", "a.cz/./a/%2E%2e/../../c/.", "https://a.cz/x/..", "a.cz/a..b/.c/...", "a.cz/a/b/../../?q=../x",
                   "a.cz/%C5%BE/../%20y", "a.cz\\x\\..\\y", "a.cz/a//../b")
    assert got == ["https://a.cz/b", "https://a.cz/c", "https://a.cz", "https://a.cz/a..b/.c/...", "https://a.cz/?q=../x", "https://a.cz/%20y",
                   "https://a.cz/y", "https://a.cz/a/b"]


def test_hosts_in_ascii(evaluate):
    import random

    rng, letters = random.Random(1), "abcxyz0-háčkyžřůßœ日本語\U0001f600éß"
    hosts = ["háčky.cz", "www.ž.cz", "plain.cz", "BĚH.Praha.CZ", "日本語.jp", "a.b.c", "münchen-ost.de", "a..č", ""]
    hosts += [".".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 20))) for _ in range(2)) for _ in range(60)]
    want = [".".join(p if p.isascii() else "xn--" + p.lower().encode("punycode").decode() for p in h.split(".")) for h in hosts]
    assert evaluate(ascii_host, *hosts) == want
    assert evaluate(P.normalize_website, "Háčky.cz/a/../b", "https://user@běh.cz:8080/ž/%2e%2e/x") == [
        "https://xn--hky-ela4t.cz/b", "https://user@xn--bh-lna.cz:8080/x"]


def test_url_key(evaluate):
    assert evaluate(P.url_dedup_key, " HTTPS://WWW.a.cz/x// ", "a.cz") == ["a.cz/x", "a.cz"]


def test_fee(evaluate):
    got = evaluate(P.parse_fee, "1 800", "1500,-", "Zdarma", "", "200 300", "1.500", f"1{NBSP}800 Kč", "nic", "dobrovolné 50")
    assert got == [1800, 1500, 0, None, 200300, 1, 1800, None, 0]


def test_organizer_and_contact(evaluate):
    assert evaluate(P.extract_organizer, "Jméno: Jan Novák\nTel: 1", "Jméno:  \n", "x") == ["Jan Novák", None, None]
    assert evaluate(P.contact_extract, "Jan, jan.n@x.cz, tel 777 123 456", "777123456", "nic") == [
        "jan.n@x.cz, 777 123 456", "777123456", ""]


def test_locations(evaluate):
    got = evaluate(P.parse_location_named, "Karlovy Vary, okres Karlovy Vary, kraj Karlovarský kraj", "Brno", "")
    assert [tuple(r) for r in got] == [("Karlovy Vary", "Karlovy Vary", "Karlovarský kraj"), ("Brno", "", ""), ("", "", "")]
    got = evaluate(P.parse_location_place, "Praha, Psychiatrická nemocnice Bohnice , Kraj: Praha", "Brno", "a, b, c, Kraj: X")
    assert [tuple(r) for r in got] == [("Praha", "Psychiatrická nemocnice Bohnice", "Praha"), ("Brno", "", ""), ("a", "b, c", "X")]


def test_place_time_and_prefixes(evaluate):
    got = evaluate(P.split_place_time, "Náměstí, 10.30", "9:00, radnice", "park", "hala, 9:15, vchod")
    assert [tuple(r) for r in got] == [("Náměstí", "10:30"), ("radnice", "9:00"), ("park", ""), ("hala, , vchod", "9:15")]
    assert evaluate(lambda c: P.strip_label(c, "Délka tratí"), "Délka tratí: 10 km", "5 km") == ["10 km", "5 km"]
    assert evaluate(P.first_clock, "Start první kategorie: v 17:30", "ne") == ["17:30", ""]


def test_slug_keeps_dash_left_by_the_cut(evaluate):
    long_name = "a" * 79 + " bcd"
    assert evaluate(L.slug_base, ("Jarní běh Pávov", "2026-04-10"), (long_name, "2026-01-01")) == [
        "jarni-beh-pavov-2026", "a" * 79 + "--2026"]


def test_labels(spark, evaluate):
    assert evaluate(lambda a, b: L.price_label(a.cast("int"), b.cast("int")), ("0", "0"), ("0", None), ("5", None), (None, "3"), ("1", "2")) == [
        "0–0 Kč", "Zdarma", "od 5 Kč", "Neuvedeno", "1–2 Kč"]
    assert evaluate(L.terrain_label, "road", "weird") == ["Silnice", "weird"]
    assert evaluate(L.location_label, ("Praha", "Praha"), ("Brno", "Jihomoravský"), ("X", None), ("Y", "")) == [
        "Praha", "Brno, Jihomoravský", "X", "Y"]
    assert evaluate(lambda c: L.plural_label(c.cast("int")), "1", "2", "4", "5", "0") == ["závod", "závody", "závody", "závodů", "závodů"]
    assert evaluate(lambda c: L.date_short(c.cast("date")), "2026-04-06") == ["6. 4. 2026"]
    assert evaluate(lambda c: L.date_long(c.cast("date")), "2026-04-06") == ["pondělí 6. dubna 2026"]
    assert evaluate(lambda c: L.distance_label(F.from_json(c, "array<struct<label:string,km:double>>")),
                    '[{"km":42.195},{"km":0.8}]', "[]", '[{"km":10}]') == ["42.195 km / 800 m", "Neuvedeno", "10 km"]
    assert evaluate(lambda s, u: L.share_url("https://x.cz", s, u), ("a b", "u/1")) == ["https://x.cz/zavod/a%20b?ref=u%2F1"]
    assert evaluate(L.remap_terrain, "ultra", "road") == ["trail", "road"]


def test_token_sets(evaluate):
    def tok(c):
        return T.token_set(T.normalize_text(c))

    assert evaluate(lambda a, b: T.jaccard(tok(a), tok(b)), ("jarni beh", "beh jarni"), ("", "a"), ("a b", "x y z"), ("aa bb", "aa cc")) == [
        1.0, 1.0, 1.0, 1 / 3]
    assert evaluate(lambda a, b: T.tokens_overlap(tok(a), tok(b)), ("", "brno"), ("brno", "praha"), ("brno x", "brno")) == [
        True, False, True]


def test_word_similarity(evaluate):
    got = evaluate(T.word_similarity, ("word", "two words"), ("word", "word"), ("abc", ""), ("abc", "xyz"), ("a", None))
    assert [None if g is None else round(g, 6) for g in got] == [0.8, 1.0, 0.0, 0.0, None]


def test_word_similarity_counts_repeated_trigrams_once_a_run(evaluate):
    got = evaluate(T.word_similarity, ("ab", "ab ab"), ("ab cd", "ab ab xy cd"), ("aaaa", "aaaaaaa b"), ("ab cd", "xab ab ab cd"))
    assert [round(g, 6) for g in got] == [1.0, 0.666667, 1.0, 1.0]
    assert "array_intersect" not in str(T.word_similarity(F.col("a"), F.col("b")))  # runs are positions, not sets built for each


def test_word_edges_are_those_of_folded_ranges(spark):
    letters = spark.createDataFrame([(chr(c),) for c in range(1, 0x3000)], "c string")
    assert letters.filter(F.col("c").rlike("(?iu)[A-Za-z0-9_]") != F.col("c").rlike("(?iu)" + T._WORD_ANY_CASE)).count() == 0
    assert letters.filter(F.col("c").rlike("[A-Za-z0-9_]") != F.col("c").rlike(T._WORD)).count() == 0


def test_word_similarity_equals_brute_force(evaluate):
    import itertools
    import random
    import re

    def grams(s):
        out = []
        for w in re.findall(r"[a-z0-9]+", s.lower()):
            p = "  " + w + " "
            out += [p[i:i + 3] for i in range(len(p) - 2)]
        return out

    def brute(q, t):
        a, b = set(grams(q)), grams(t)
        best = 0.0
        for i, j in itertools.combinations(range(len(b) + 1), 2):
            run = set(b[i:j])
            best = max(best, len(run & a) / len(run | a))
        return best

    rng = random.Random(3)
    words = ["maraton", "praha", "pulmaraton", "beh", "brno", "trail", "mara", "ton", "prah"]
    rows = [(" ".join(rng.sample(words, 2)), " ".join(rng.choices(words, k=rng.randint(1, 5)))) for _ in range(40)]
    got = evaluate(T.word_similarity, *rows)
    assert all(abs(g - brute(*r)) < 1e-6 for g, r in zip(got, rows))


def test_single_values_are_not_split(spark):
    rows = spark.createDataFrame([("10 km",), ("5/12,05 km / 12 km",), ("a/b 3 km",), ("1. 5. 2025 – 2. 5. 2025",), (None,)], "v string")
    found = rows.select(P.parse_distances(F.col("v")).alias("d"), P.normalize_date(F.col("v")).alias("day"))
    got = found.collect()
    assert [[tuple(x) for x in r.d] for r in got[:3]] == [[("10 km", 10.0)], [("12,05 km", 12.05), ("5", 5.0)], [("a/b 3 km", 3.0)]]
    assert got[3].day == "2025-05-01" and got[4].day is None and got[4].d == []
    plan = rows.select(P.normalize_date(F.col("v")).alias("day"))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"split\([^()]*\[–—\]", plan) is None
