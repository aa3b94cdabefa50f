"""PII: keyed pseudonyms that keep the format of validated numbers, dates and mail addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import keeping, query, table

#: A number in groups must not go on as another number, name or address before or behind it.
_ALONE, _ENDS = r"(?<![0-9A-Za-z_])(?<![0-9A-Za-z][./-])", r"(?![0-9A-Za-z_@%+]|[./-][0-9A-Za-z@])"
#: Cards in groups of digits with single spaces or hyphens, and phone numbers without a country.
CARD = "|".join(rf"[0-9]{{4}}{s}(?:[0-9]{{4}}{s}[0-9]{{4}}{s}[0-9]{{4}}|[0-9]{{6}}{s}[0-9]{{4,5}})" for s in " -")
NATIONAL = r"(?:1[ -])?(?:\([0-9]{3}\)[ -]?[0-9]{3}[ -][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})|[0-9]{3}\.[0-9]{3}\.[0-9]{4}"
#: What is looked at, first alternative first; each match is then validated whole.
CANDIDATE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    r"|\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?[ -]?[0-9]{3,4}[ -]?[0-9]{3,4}"
    rf"|{_ALONE}(?:{CARD}|{NATIONAL}){_ENDS}"
    r"|[0-9]+(?:\.[0-9]+)+|[0-9]+(?:-[0-9]+)+|[0-9]+(?:/[0-9]+)+|[0-9]+"
)
KINDS = ("email", "phone", "ip", "iso_date", "day_date", "ssn", "card")
ROUNDS = 8
#: 400 Gregorian years are 146,097 = 189 x 773 days; dates from 1800-01-01 on, so that a permutation has no gaps to step over.
FIRST_DAY, DAY_HIGH, DAY_LOW = "1800-01-01", 189, 773
#: Valid social security numbers: 898 areas x 99 groups, 9,999 serials.
SSN_HIGH, SSN_LOW = 898 * 99, 9999
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _digest(key: str, kind: str, i: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string")), 256)


def _number(hexes: Column) -> Column:
    return F.conv(hexes, 16, 10).cast("long")


def permute_number(value: Column, high: int, low: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. high * low - 1: the halves take turns in being shifted by a digest of the other."""
    start = F.struct((value / F.lit(low)).cast("long").alias("a"), F.pmod(value, F.lit(low)).cast("long").alias("b"))

    def step(s: Column, i: Column) -> Column:
        a = F.when(i % 2 == 0, F.pmod(s["a"] + _number(F.substring(_digest(key, kind, i, s["b"]), 1, 12)), F.lit(high)))
        b = F.when(i % 2 == 1, F.pmod(s["b"] + _number(F.substring(_digest(key, kind, i, s["a"]), 1, 12)), F.lit(low)))
        return F.struct(F.coalesce(a, s["a"]).cast("long").alias("a"), F.coalesce(b, s["b"]).cast("long").alias("b"))

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step, lambda s: s["a"] * F.lit(low) + s["b"])


def _shift(half: Column, digest: Column) -> Column:
    """Every digit and letter moved inside its own class by a byte of the digest; other characters stay."""

    def one(c: Column, p: Column) -> Column:
        k = F.conv(F.substr(digest, F.pmod(p, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        moved = lambda alphabet: F.substr(
            F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), c) - 1 + k, F.lit(len(alphabet))) + 1, F.lit(1))
        return (F.when(c.rlike("^[0-9]$"), moved("0123456789")).when(c.rlike("^[a-z]$"), moved(LETTERS))
                .when(c.rlike("^[A-Z]$"), moved(LETTERS.upper())).otherwise(c))

    return F.array_join(F.transform(F.split(half, ""), one), "")


def permute_text(value: Column, key: str, kind: str) -> Column:
    """A keyed permutation of all strings with the same classes of characters in the same places."""
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), cut).alias("a"), F.substr(value, cut + 1).alias("b"))

    def step(s: Column, i: Column) -> Column:
        a = F.when(i % 2 == 0, _shift(s["a"], _digest(key, kind, i, s["b"]))).otherwise(s["a"])
        b = F.when(i % 2 == 1, _shift(s["b"], _digest(key, kind, i, s["a"]))).otherwise(s["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["a"], s["b"]))


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum from the right; the digits at distance ``doubled``, ``doubled`` + 2, .. from the right end are doubled."""

    def add(total: Column, c: Column) -> Column:
        d = c["d"].cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(c["p"] % 2 == doubled, twice).otherwise(d)

    rows = F.transform(F.split(F.reverse(digits), ""), lambda d, p: F.struct(d.alias("d"), p.alias("p")))
    return F.aggregate(rows, F.lit(0), add)


def kind_of(value: Column) -> Column:
    """The kind of a whole candidate, NULL if it isn't a valid one."""
    octets = F.split(value, r"\.")
    digits = F.regexp_replace(value, "[^0-9]", "")
    days = lambda d: d.isNotNull() & F.year(d).between(1800, 2199)
    return (
        F.when(value.contains("@"), "email")
        .when(value.startswith("+") & F.length(digits).between(8, 15) | value.rlike(f"^(?:{NATIONAL})$"), "phone")
        .when(value.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$")
              & F.forall(octets, lambda o: o.try_cast("int") <= 255), "ip")
        .when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & days(value.try_cast("date")), "iso_date")
        .when(value.rlike(r"^[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}$") & days(_day_first(value)), "day_date")
        .when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ~value.rlike(r"^(000|666|9)|-00-|-0000$"), "ssn")
        .when(value.rlike(rf"^(?:[0-9]{{13,19}}|{CARD})$") & (F.pmod(luhn_sum(digits, 1), F.lit(10)) == 0), "card")
    )


def _day_first(value: Column) -> Column:
    parts = F.split(value, "[./]")
    return F.concat_ws("-", F.get(parts, F.lit(2)), F.lpad(F.get(parts, F.lit(1)), 2, "0"),
                       F.lpad(F.get(parts, F.lit(0)), 2, "0")).try_cast("date")


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a valid value; equal values have equal ones, different values different ones."""
    at = F.instr(value, "@")
    email = F.concat(permute_text(F.substr(value, F.lit(1), at - 1), key, "email"), F.substr(value, at))
    country = F.regexp_extract(value, r"^\+[0-9]{1,3}?(?=[ -]|\(|[0-9]{7})", 0)
    phone = F.concat(country, permute_text(F.substr(value, F.length(country) + 1), key, "phone"))
    octet = lambda i: F.get(F.split(value, r"\."), F.lit(i)).cast("long")
    address = permute_number(((octet(0) * 256 + octet(1)) * 256 + octet(2)) * 256 + octet(3), 65536, 65536, key, "ip")
    ip = F.aggregate(F.array(address), F.lit(""), lambda _, n: F.concat_ws(".", *[
        F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))
    moved = lambda day: F.date_add(F.lit(FIRST_DAY).cast("date"), permute_number(
        F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long"), DAY_HIGH, DAY_LOW, key, "date").cast("int"))
    iso = F.date_format(moved(value.cast("date")), "yyyy-MM-dd")
    sep = F.regexp_extract(value, "[./]", 0)
    day_first = F.aggregate(F.array(moved(_day_first(value))), F.lit(""), lambda _, d: F.concat_ws(
        "", F.date_format(d, "dd"), sep, F.date_format(d, "MM"), sep, F.date_format(d, "yyyy")))
    part = lambda i, n: F.substring(value, i, n).cast("long")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    ssn = F.aggregate(
        F.array(permute_number((area * 99 + part(5, 2) - 1) * SSN_LOW + part(8, 4) - 1, SSN_HIGH, SSN_LOW, key, "ssn")),
        F.lit(""), lambda _, n: _ssn_text(n))
    digits = F.regexp_replace(value, "[ -]", "")
    card = F.aggregate(
        F.array(permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")), F.lit(""),
        lambda _, n: _spaced_like(value, F.concat(n, F.pmod(-luhn_sum(n, 0), F.lit(10)).cast("string"))))
    return (F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ip", ip)
            .when(kind == "iso_date", iso).when(kind == "day_date", day_first).when(kind == "ssn", ssn)
            .when(kind == "card", card))


def _spaced_like(value: Column, digits: Column) -> Column:
    """``digits`` with the separators of ``value`` in their places."""
    groups = F.split(value, "[ -]")
    start = F.struct(digits.alias("rest"), F.array().cast("array<string>").alias("parts"))
    parts = F.aggregate(groups, start, lambda s, g: F.struct(
        F.substr(s["rest"], F.length(g) + 1).alias("rest"),
        F.concat(s["parts"], F.array(F.substr(s["rest"], F.lit(1), F.length(g)))).alias("parts")), lambda s: s["parts"])
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i > 0, F.regexp_extract(value, "[ -]", 0)).otherwise(""), p)), "")


def _ssn_text(n: Column) -> Column:
    high, serial = (n / F.lit(SSN_LOW)).cast("long"), F.pmod(n, F.lit(SSN_LOW)) + 1
    area = (high / F.lit(99)).cast("long") + 1
    area = area + F.when(area >= 666, 1).otherwise(0)
    pad = lambda x, w: F.lpad(x.cast("string"), w, "0")
    return F.concat_ws("-", pad(area, 3), pad(F.pmod(high, F.lit(99)) + 1, 2), pad(serial, 4))


def pseudonymise(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text with its valid numbers, dates and mail addresses replaced by keyed pseudonyms.

    Returns one row per input row: doc_id, text, found (array of kind, start,
    stop in the input text, pseudonym).  A value keeps its format (card numbers
    their check digit, addresses their range, dates their notation) and is
    permuted by a keyed Feistel network, so that equal values stay equal across
    documents and different ones differ.  Cards are 13 to 19 digits, or groups
    of 4-4-4-4, 4-6-5 or 4-6-4 with one kind of separator (the pseudonym is that
    of the digits alone); phones have a leading + or are like (555) 123-4567,
    555-123-4567 or 555.123.4567, the first two with or without a 1 before.  Other groupings
    and national numbers without brackets, hyphens or points are not known:
    they can't be told from other numbers.  Candidates that fail validation stay
    as they are.  No row meets another: nothing is shuffled.

    NULL text stays NULL and has no finds; empty input gives no rows; repeated
    rows give repeated results; only the two named columns are read.
    """
    rows = keeping(docs, {"doc_id": F.col(doc_id), "text": F.col(text)})
    t = F.col("text")
    hits = F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))
    judged = F.transform(hits, lambda h: F.struct(h.alias("was"), kind_of(h).alias("kind")))
    replaced = F.transform(judged, lambda h: F.struct(
        h["was"], h["kind"], F.coalesce(pseudonym(h["was"], h["kind"], key), h["was"]).alias("now")))
    touched = t.rlike("[0-9@]")
    none = "array<struct<was:string,kind:string,now:string>>"
    rows = rows.withColumn("hits", F.when(touched, replaced).otherwise(F.array().cast(none)))
    rows = rows.withColumn("gaps", F.when(touched, F.split(t, CANDIDATE, -1)).otherwise(F.array(t)))
    joined = F.array_join(F.flatten(F.transform("gaps", lambda g, i: F.array(
        g, F.coalesce(F.get(F.col("hits"), i)["now"], F.lit(""))))), "")
    return rows.select("doc_id", F.when(touched, joined).otherwise(t).alias("text"),
                       F.filter(_positions(), lambda h: h["kind"].isNotNull()).alias("found"))


def _positions() -> Column:
    found = "array<struct<kind:string,start:int,stop:int,pseudonym:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(found).alias("found"))
    pairs = F.arrays_zip(F.col("hits").alias("hit"), F.slice("gaps", 1, F.size("hits")).alias("gap"))

    def step(s: Column, p: Column) -> Column:
        at = s["at"] + F.length(p["gap"])
        stop = at + F.length(p["hit"]["was"])
        span = F.struct(p["hit"]["kind"].alias("kind"), at.alias("start"), stop.alias("stop"), p["hit"]["now"].alias("pseudonym"))
        return F.struct(stop.alias("at"), F.when(p["hit"]["kind"].isNull(), s["found"])
                        .otherwise(F.concat(s["found"], F.array(span))).alias("found"))

    return F.when(F.size("hits") == 0, F.array().cast(found)).otherwise(F.aggregate(pairs, start, step, lambda s: s["found"]))


#: The key of the registered query; real jobs pass their own secret.
QUERY_KEY = "paceline-query-key"


@query("op7_pseudonyms")
def op7_pseudonyms(spark, sf_dir):
    out = pseudonymise(table(spark, sf_dir, "documents"), QUERY_KEY)
    count = lambda kinds: F.size(F.filter("found", lambda h: h["kind"].isin(kinds))).cast("long")
    names = {"n_email": ["email"], "n_phone": ["phone"], "n_ip": ["ip"], "n_date": ["iso_date", "day_date"],
             "n_ssn": ["ssn"], "n_card": ["card"]}
    spans = F.array_join(F.transform("found", lambda h: F.concat_ws(
        ":", h["kind"], h["start"].cast("string"), h["stop"].cast("string"))), ",")
    return out.select("doc_id", "text", *[count(k).alias(n) for n, k in names.items()], spans.alias("spans"))
