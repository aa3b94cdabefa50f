"""Field parsers for listing text.  Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceline import fixed_values as V
from paceline.functions.hosts import ascii_host
from paceline.functions.text import (
    BLANKS, NOT_WS, WS, drop_blanks, is_blank, let, like, null_if_empty, pattern, replace_first, trim_blanks,
)

DISTANCES = "array<struct<label:string,km:double>>"


def lookup(table: dict, key: Column) -> Column:
    """Value of a constant dictionary, NULL when the key is unknown."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def _month_number(name: Column) -> Column:
    return lookup({m: f"{i:02d}" for i, m in enumerate(V.MONTHS_GENITIVE, 1)}, F.lower(name))


def _dotted_date(text: Column) -> Column:
    """ISO form of D.M.YYYY, blanks anywhere; NULL otherwise."""
    shape = r"^\d{1,2}\.\d{1,2}\.\d{4}$"

    def iso(dense):
        day, month, year = (F.get(F.split(dense, r"\."), F.lit(i)) for i in range(3))
        return F.when(dense.rlike(shape), F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))

    return let(drop_blanks(text), iso)


def _worded_date(text: Column, shape: str) -> Column:
    """ISO form of a day, month word and year; NULL when the word is no month."""
    def iso(month):
        day = F.lpad(F.regexp_extract(text, shape, 1), 2, "0")
        return F.when(month.isNotNull(), F.concat_ws("-", F.regexp_extract(text, shape, 3), month, day))

    return let(_month_number(F.regexp_extract(text, shape, 2)), iso)


def normalize_date(raw: Column) -> Column:
    """ISO start date of a listing, as text: an ISO input is not checked against the calendar."""
    def start_of(text):
        first = F.regexp_extract(text, rf"(?s)^(.*?)(?:{WS}*[–—]{WS}*(?=\d)|\z)", 1)
        return F.when(text.contains("–") | text.contains("—"), trim_blanks(first)).otherwise(text)

    return let(let(trim_blanks(raw), start_of), lambda s: F.coalesce(
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s),
        F.when(s.contains("."), _dotted_date(s)),
        _worded_date(s, rf"^(\d{{1,2}})\.{WS}*({NOT_WS}+){WS}+(\d{{4}})$"),
    ))


def extractor_date(raw: Column, site: Column) -> Column:
    """Date as the site's own collector leaves it; text it cannot read passes through."""
    words = trim_blanks(F.get(F.split(raw, "–"), F.lit(0)))
    worded = let(words, lambda w: _worded_date(w, rf"(\d{{1,2}})\.{WS}*(\w+){WS}+(\d{{4}})"))
    return F.coalesce(F.when(site == "ceskybeh", worded).otherwise(_dotted_date(raw)), raw)


def _by_km_desc(distances: Column) -> Column:
    keyed = F.transform(distances, lambda d: F.struct(d["km"].alias("km"), d["label"].alias("label")))
    ranked = F.sort_array(keyed, asc=False)
    return F.transform(ranked, lambda d: F.struct(d["label"].alias("label"), d["km"].alias("km")))


def sort_distances(distances: Column) -> Column:
    """Longest distance first."""
    return _by_km_desc(distances)


def round_half_up(value: Column, digits: int) -> Column:
    scale = 10 ** digits
    return F.floor(value * scale + 0.5) / scale


def parse_distances(raw: Column) -> Column:
    """Array of ``{label, km}`` read from one text, longest first, near repeats dropped."""
    parts = F.when(raw.contains("/"), F.transform(F.split(raw, rf"{WS}*/{WS}*(?=\d)"), trim_blanks)).otherwise(F.array(trim_blanks(raw)))
    usable = F.filter(parts, lambda s: s.rlike(r"\d") & ~like(s, V.NOT_A_DISTANCE) & (~like(s, V.RELAY) | like(s, "km")))
    value_shape = pattern(V.KM_VALUE, ignore_case=True)

    def entry(seg):
        number = null_if_empty(F.regexp_replace(F.regexp_extract(seg, value_shape, 1), ",", ".")).try_cast("double")
        miles = F.lower(F.regexp_extract(seg, value_shape, 2)).isin("míle", "mil")
        number = let(number, lambda n: F.when(miles, round_half_up(n * V.KM_PER_MILE, 1)).otherwise(n))
        label = trim_blanks(F.regexp_replace(seg, rf"{WS}*\+?{WS}*$", ""))
        return F.struct(label.alias("label"), let(number, lambda n: F.when(n > 0, n)).alias("raw"))

    read = F.filter(F.transform(usable, entry), lambda d: d["raw"].isNotNull())
    rounded = F.transform(read, lambda d: F.struct(d["label"].alias("label"), round_half_up(d["raw"], 2).alias("km")))

    def apart(entries):
        return F.aggregate(
            entries,
            F.array().cast(DISTANCES),
            lambda acc, d: F.when(
                F.exists(acc, lambda e: F.abs(e["km"] - d["km"]) < V.ROW_TOLERANCE_KM), acc
            ).otherwise(F.concat(acc, F.array(d))),
        )

    several = let(rounded, lambda r: F.when(F.size(r) > 1, _by_km_desc(apart(r))).otherwise(r)).cast(DISTANCES)
    return F.coalesce(F.when(raw.rlike(r"\d"), several), F.array().cast(DISTANCES))


def surface_to_terrain(raw: Column) -> Column:
    both = like(raw, V.ROAD_WORDS) & like(raw, V.OFFROAD_WORDS)
    chain = F.when(is_blank(raw), "road").when(both, "mixed")
    for word, terrain in V.TERRAIN_KEYWORDS:
        chain = chain.when(like(raw, word), terrain)
    return chain.otherwise("road")


def normalize_time(raw: Column) -> Column:
    """First clock time as HH:MM; midnight and impossible times are NULL."""
    colons = replace_first(raw, r"(\d{1,2})\.(\d{2})(?!\d)", "$2:$3")
    clock = F.lpad(F.regexp_extract(colons, r"\d{1,2}:\d{2}", 0), 5, "0")
    return let(clock, lambda c: F.when(c.rlike(r"^([01]\d|2[0-3]):[0-5]\d$") & (c != "00:00"), c))


def normalize_city(raw: Column) -> Column:
    def without_brackets(text):
        cut = trim_blanks(F.regexp_replace(text, rf"{WS}*\([^)]*\){WS}*", " "))
        return F.when(text.contains("("), cut).otherwise(text)

    def start(city):
        stops = F.split(city, rf"{WS}*-{WS}*")
        route = lambda s: (F.size(s) >= 3) & F.forall(s, lambda p: F.length(p) < 20)
        first = let(stops, lambda s: F.when(route(s), F.get(s, F.lit(0))).otherwise(city))
        return F.when(city.contains("-"), first).otherwise(city)

    def unnumbered(city):
        bare = F.regexp_replace(city, pattern(V.NUMBERED_CITY, ignore_case=True), "$1")
        return trim_blanks(F.when(city.rlike(r"\d$"), bare).otherwise(city))

    bare = let(trim_blanks(raw), without_brackets)
    place = trim_blanks(F.regexp_replace(bare, pattern(V.VENUE_PREFIX, ignore_case=True), ""))
    return let(let(place, start), unnumbered)


def normalize_region(raw: Column) -> Column:
    return lookup(V.REGIONS, F.lower(trim_blanks(raw)))


def is_foreign_region(raw: Column) -> Column:
    return F.coalesce(F.lower(trim_blanks(raw)).isin(*V.FOREIGN_REGIONS), F.lit(False))


def _percent_encode(text: Column) -> Column:
    """Encode blanks, quotes, brackets and everything outside ASCII; keep the rest."""
    plain = r"[\x21\x23-\x3B\x3D\x3F-\x5D\x5F\x61-\x7A\x7C\x7E]+"
    runs = F.regexp_extract_all(text, F.lit(rf"({plain}|[^\x21\x23-\x3B\x3D\x3F-\x5D\x5F\x61-\x7A\x7C\x7E]+)"), F.lit(1))
    coded = F.transform(
        runs, lambda r: F.when(r.rlike(f"^{plain}"), r).otherwise(F.replace(F.url_encode(r), F.lit("+"), F.lit("%20")))
    )
    return F.array_join(coded, "")


_DOT, _DOTS = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"


def without_dot_segments(path: Column) -> Column:
    """A rooted path with its ``.`` parts left out and ``..`` parts taken back, also where the dots are escaped."""
    def fold(kept, part):
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part.rlike(_DOTS), up).when(part.rlike(_DOT), kept).otherwise(F.concat(kept, F.array(part)))

    def resolved(parts):
        ends = F.when(F.element_at(parts, -1).rlike(r"(?i)^(\.|%2e){1,2}$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(parts, F.array().cast("array<string>"), fold), ends), "/"))

    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), let(F.split(F.substring(path, 2, 1 << 30), "/", -1), resolved)).otherwise(path)


def normalize_website(raw: Column) -> Column:
    """Clean absolute URL without trailing slashes; NULL when blank or not a URL.

    Dot parts of the path are resolved; host names are lower-cased and put in
    their ASCII form.
    """
    shape = r"(?s)^([hH][tT][tT][pP][sS]?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"

    def absolute(text):
        return F.regexp_replace(F.when(text.startswith("http"), text).otherwise(F.concat(F.lit("https://"), text)), r"[\t\r\n]", "")

    def split(url):
        part = {n: F.regexp_extract(url, shape, i) for i, n in enumerate(("scheme", "authority", "path", "query", "mark"), 1)}
        return let(F.struct(
            F.lower(part["scheme"]).alias("scheme"),
            F.regexp_extract(part["authority"], r"^(.*@)?", 0).alias("login"),
            F.regexp_replace(part["authority"], r"^.*@", "").alias("host_port"),
            F.replace(part["path"], F.lit("\\"), F.lit("/")).alias("path"),
            F.concat(part["query"], part["mark"]).alias("rest"),
        ), lambda u: let(F.struct(
            let(F.lower(F.regexp_replace(u["host_port"], r":\d*$", "")), ascii_host).alias("host"),
            F.regexp_extract(u["host_port"], r":(\d+)$", 1).alias("port"),
        ), lambda h: build(u, h)))

    def build(u, h):
        number = null_if_empty(h["port"]).try_cast("int")
        usual = F.when(u["scheme"] == "http", 80).otherwise(443)
        port = F.when((h["port"] == "") | (number == usual), "").otherwise(F.concat(F.lit(":"), number.cast("string")))
        valid = (
            (u["scheme"] != "") & (h["host"] != "") & ~h["host"].rlike(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7F]")
            & ((h["port"] == "") | F.coalesce(number <= 65535, F.lit(False)))
        )
        path = F.when(u["path"] == "", "/").otherwise(without_dot_segments(u["path"]))
        whole = F.concat(u["scheme"], F.lit("://"), u["login"], h["host"], port, _percent_encode(path), _percent_encode(u["rest"]))
        return F.when(valid, F.regexp_replace(whole, "/+$", ""))

    clean = let(trim_blanks(raw), lambda t: F.when(t != "", let(absolute(t), split)))
    return F.when(raw.isNotNull(), clean)


def url_dedup_key(url: Column) -> Column:
    key = F.regexp_replace(F.lower(trim_blanks(url)), "^https?://", "")
    return F.regexp_replace(F.regexp_replace(key, r"^www\.", ""), "/+$", "")


def parse_fee(raw: Column) -> Column:
    """Whole amount; free and voluntary words are 0; blank or no number is NULL."""
    free = F.lower(raw).rlike("|".join(V.FREE_WORDS))
    digits = F.regexp_extract(raw, rf"(\d[\d{BLANKS}]*\d|\d+)", 1)
    return F.when(free, F.lit(0).cast("bigint")).otherwise(null_if_empty(drop_blanks(digits)).try_cast("bigint"))


def price_bounds(pre: Column, on_site: Column) -> tuple[Column, Column]:
    """Lowest and highest fee; zero is a value, not a gap."""
    return F.coalesce(pre, on_site), F.coalesce(on_site, pre)


def extract_organizer(contact: Column) -> Column:
    return null_if_empty(trim_blanks(F.regexp_extract(contact, pattern(r"Jméno:\s*([^\n]+)"), 1)))


def split_parts(raw: Column) -> Column:
    return F.transform(F.split(raw, ","), trim_blanks)


def parse_location_named(raw: Column) -> Column:
    """``city, okres X, kraj Y`` -> struct(city, district, region)."""
    def after(parts, prefix):
        hit = F.get(F.filter(parts, lambda p: p.startswith(prefix)), F.lit(0))
        return F.coalesce(F.regexp_replace(hit, f"^{prefix}", ""), F.lit(""))

    return let(split_parts(raw), lambda p: F.struct(
        F.coalesce(F.get(p, F.lit(0)), F.lit("")).alias("city"),
        after(p, "okres ").alias("district"), after(p, "kraj ").alias("region"),
    ))


def parse_location_place(raw: Column) -> Column:
    """``city, place, Kraj: Y`` -> struct(city, start_place, region)."""
    def fields(parts, halves):
        place = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), ", ")
        return F.struct(
            F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("city"),
            F.coalesce(place, F.lit("")).alias("start_place"),
            F.coalesce(trim_blanks(F.get(halves, F.lit(1))), F.lit("")).alias("region"),
        )

    return let(F.split(raw, pattern(r",?\s*Kraj:\s*")), lambda h: let(
        F.filter(split_parts(F.get(h, F.lit(0))), lambda p: p != ""), lambda p: fields(p, h)))


def split_place_time(raw: Column) -> Column:
    """``place, H:MM`` -> struct(place, time)."""
    shape = r"\d{1,2}[:.]\d{2}"
    rest = replace_first(raw, shape, "")
    rest = F.regexp_replace(F.regexp_replace(rest, f",{WS}*$", ""), f"^{WS}*,", "")
    return F.struct(
        trim_blanks(rest).alias("place"),
        F.replace(F.regexp_extract(raw, shape, 0), F.lit("."), F.lit(":")).alias("time"),
    )


def contact_extract(raw: Column) -> Column:
    """First e-mail and first nine-digit phone."""
    mail = null_if_empty(F.regexp_extract(raw, r"[\w.-]+@[\w.-]+\.\w+", 0))
    phone = null_if_empty(F.regexp_extract(raw, rf"\d{{3}}{WS}?\d{{3}}{WS}?\d{{3}}", 0))
    return F.concat_ws(", ", mail, phone)


def strip_label(raw: Column, label: str) -> Column:
    return F.regexp_replace(raw, f"^{label}:{WS}*", "")


def first_clock(raw: Column) -> Column:
    return F.regexp_extract(raw, r"\d{1,2}:\d{2}", 0)
