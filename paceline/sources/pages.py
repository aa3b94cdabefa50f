"""Stored web pages to raw listing rows.  ``pages`` has ``page_id, url, html``.

Markup is read with JVM regular expressions, row by row: no shuffle and no
Python.  ``blocks`` finds where an element ends by counting its tags, so that
elements of its kind may nest inside; the cells, terms and paragraphs read
inside blocks must not nest inside themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline import fixed_values as V
from paceline.functions import parse as P
from paceline.functions.text import let, null_if_empty, trim_blanks

PAIRS = "array<struct<label:string,value:string>>"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def inner_text(markup: Column) -> Column:
    """Text without tags, common entities decoded, trimmed."""
    text = F.regexp_replace(markup, r"(?s)<!--.*?-->|<[^>]*>", "")
    for code, char in ENTITIES.items():
        text = F.replace(text, F.lit(code), F.lit(char))
    return trim_blanks(text)


def _element(html: Column, tag: str) -> Column:
    return F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)


def blocks(html: Column, *classes: str, tag: str = "div") -> Column:
    """The contents of every ``tag`` element that has all the classes, up to its own closing tag.

    The text behind each opening tag is cut where as many ``tag`` elements have
    closed as opened.  An element that never closes reaches to the next one
    of its classes, or to the end.
    """
    has = "".join(rf'(?=[^>]*\sclass="(?:[^"]*\s)?{c}(?:\s[^"]*)?")' for c in classes)
    pieces = F.split(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), rf"(?is)<{tag}{has}(?:\s[^>]*)?>", -1)
    edge = rf"(?is)<{tag}(?:\s[^>]*)?>|</{tag}\s*>"

    def closing(edges):
        """How many tags lie before the one that closes the element; NULL if none does."""
        def step(at, t):
            depth = at["depth"] + F.when(t.startswith("</"), -1).otherwise(1)
            return F.when(at["done"], at).otherwise(F.struct(depth.alias("depth"), (at["before"] + F.when(depth == 0, 0).otherwise(1)).alias("before"), (depth == 0).alias("done")))

        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("before"), F.lit(False).alias("done"))
        return F.aggregate(edges, start, step, lambda at: at["before"])

    def content(piece):
        def cut(gaps, edges):
            return let(closing(edges), lambda n: F.array_join(F.transform(
                F.slice(gaps, F.lit(1), n + 1), lambda g, i: F.concat(g, F.when(i < n, F.get(edges, i)).otherwise(F.lit("")))), ""))

        return let(F.struct(F.split(piece, edge, -1).alias("g"), F.regexp_extract_all(piece, F.lit(edge), F.lit(0)).alias("e")),
                   lambda p: cut(p["g"], p["e"]))

    return F.transform(F.slice(pieces, 2, 1 << 30), content)


def page_title(html: Column, heading: str = "h1", empty_counts: bool = False) -> Column:
    """First heading's text, else the page title.

    A heading without text is passed over too, unless ``empty_counts``, as in
    the table layout.
    """
    text, title = inner_text(_element(html, heading)), inner_text(_element(html, "title"))
    if empty_counts:
        return F.when(html.rlike(rf"(?is)<{heading}(?:\s[^>]*)?>.*?</{heading}\s*>"), text).otherwise(title)
    return F.coalesce(null_if_empty(text), title)


def absolute_url(base: Column, href: Column) -> Column:
    """Link target against its page: absolute, scheme-relative, rooted or sibling."""
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    scheme = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(page == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.rlike("^[?#]") , F.concat(page, href))
        .otherwise(F.concat(folder, href))
    )


def first_href(markup: Column) -> Column:
    return F.regexp_extract(markup, r'(?is)<a\s[^>]*?href="([^"]*)"', 1)


def _pairs(cells: Column, label, value) -> Column:
    """Labels and values read from an array of cells ``l, v``; pairs without one of them are left out."""
    read = F.transform(cells, lambda z: F.struct(label(z["l"]).alias("label"), value(z["v"]).alias("value")))
    return F.filter(read, lambda p: (p["label"] != "") & (p["value"] != "")).cast(PAIRS)


def _cells(html: Column, shape: str) -> Column:
    """The two groups of every match, for text that is mostly matches."""
    return let(html, lambda h: F.arrays_zip(
        F.regexp_extract_all(h, F.lit(shape), F.lit(1)).alias("l"), F.regexp_extract_all(h, F.lit(shape), F.lit(2)).alias("v")))


def _few_cells(html: Column, shape: str) -> Column:
    """The same for text with few matches: it is searched once, and the groups are read from the matches alone."""
    return F.transform(F.regexp_extract_all(html, F.lit(shape), F.lit(0)), lambda m: F.struct(
        F.regexp_extract(m, shape, 1).alias("l"), F.regexp_extract(m, shape, 2).alias("v")))


def table_pairs(html: Column, url: Column) -> Column:
    """Rows of the detail table: label without colon; link target before text."""
    def label(cell):
        return F.lower(F.regexp_replace(inner_text(cell), ":$", ""))

    def value(cell):
        return let(first_href(cell), lambda h: F.when(h != "", absolute_url(url, h)).otherwise(inner_text(cell)))

    table = F.regexp_extract(html, r'(?is)<table[^>]*class="(?:[^"]*\s)?race(?:\s[^"]*)?"[^>]*>(.*?)</table>', 1)
    return _pairs(_cells(table, r"(?is)<tr[^>]*>\s*<td[^>]*>(.*?)</td>\s*<td[^>]*>(.*?)</td>"), label, value)


def term_pairs(html: Column) -> Column:
    """Term and parameter blocks: link text before text; parameters after terms."""
    def label(part):
        return F.lower(inner_text(part))

    def term(part):
        return let(inner_text(_element(part, "a")), lambda a: F.when(a != "", a).otherwise(inner_text(part)))

    def shape(a, b):
        return rf'(?is)<(?:div|span|dt|p)[^>]*class="[^"]*{a}[^"]*"[^>]*>(.*?)</(?:div|span|dt|p)>\s*<(?:div|span|dd|p)[^>]*class="[^"]*{b}(?![^"]*race-social-links)[^"]*"[^>]*>(.*?)</(?:div|span|dd|p)>'

    return F.concat(
        _pairs(_few_cells(html, shape("terms__note", "terms__text")), label, term),
        _pairs(_few_cells(html, shape("parameters__title", "parameters__value")), label, inner_text),
    )


def icon_pairs(html: Column) -> Column:
    """Paragraphs of the detail block tagged by an icon anywhere in them: its field and the text; the web icon gives its link."""
    def field(icon):
        chain = F.lit(None).cast("string")
        for mark, name in reversed(V.ICON_FIELDS.items()):
            chain = F.when(icon.contains(mark), name).otherwise(chain)
        return F.coalesce(chain, F.lit(""))

    texts = F.flatten(F.transform(blocks(html, V.DETAIL_BLOCK), lambda d: blocks(d, *V.DETAIL_TEXT)))
    paragraphs = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))))

    def entries(body):
        def made(name):
            link = first_href(body)
            text = F.when(name == "website", link).otherwise(inner_text(body))
            own = F.struct(name.alias("label"), text.alias("value"))
            web = F.struct(F.lit("organizerWeb").alias("label"), F.when(name == "organizer", link).otherwise("").alias("value"))
            return F.array(own, web)

        return let(field(F.regexp_extract(body, r'(?is)<i\s[^>]*?class="([^"]*)"', 1)), made)

    flat = F.flatten(F.transform(paragraphs, entries))
    return F.filter(flat, lambda p: (p["label"] != "") & (p["value"] != "")).cast(PAIRS)


def pick_labels(pairs: Column, labels: dict[str, str]) -> dict[str, Column]:
    """Field -> last non-empty value among its labels, ``''`` when absent."""
    fields: dict[str, list[str]] = {}
    for label, field in labels.items():
        fields.setdefault(field, []).append(label)

    def last(names):
        hits = F.filter(pairs, lambda p: p["label"].isin(*names))
        return F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.lit(""))

    return {field: last(names) for field, names in fields.items()}


def label_values(pages: DataFrame, pairs) -> DataFrame:
    """One row per label and value, in page order."""
    return pages.select("page_id", F.posexplode(pairs).alias("pos", "p")).select("page_id", "pos", "p.label", "p.value")


def link_extract(pages: DataFrame, include: str, exclude: str | None = None) -> DataFrame:
    """Distinct link targets that match a glob and not another; ``*`` is one path part, ``**`` any rest."""
    found = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)href="([^"]+)"'), F.lit(1))).alias("href"))
    target = found.select("page_id", absolute_url(F.col("url"), F.col("href")).alias("target")).filter(F.col("target").rlike(glob_regex(include)))
    if exclude:
        target = target.filter(~F.col("target").rlike(glob_regex(exclude)))
    return target.distinct()


def location_links(pages: DataFrame, entry: str = "race-single") -> DataFrame:
    """Distinct targets that list entries hold in ``data-location``, without a trailing question mark."""
    tags = F.explode(F.regexp_extract_all("html", F.lit(rf'(?is)<\w+\s[^>]*class="[^"]*\b{entry}\b[^"]*"[^>]*>'), F.lit(0)))
    held = pages.select("page_id", "url", tags.alias("tag")).select(
        "page_id", "url", F.regexp_replace(F.regexp_extract("tag", r'(?i)\sdata-location="([^"]*)"', 1), r"\?$", "").alias("href"))
    return held.filter("href <> ''").select("page_id", absolute_url(F.col("url"), F.col("href")).alias("target")).distinct()


def glob_regex(glob: str) -> str:
    out = ""
    for part in glob.replace("**", "\0").split("*"):
        out += "".join(".*" if c == "\0" else (c if c.isalnum() or c in "/:_-" else "\\" + c) for c in part) + "[^/]*"
    return "^" + out[: -len("[^/]*")] + "$"


#: A linked number above this is no page number.
MOST_PAGES = 100_000


def _linked_numbers(shape: str) -> Column:
    return F.transform(F.regexp_extract_all("html", F.lit(shape), F.lit(1)), lambda n: n.try_cast("decimal(38,0)"))


def pagination_expand(pages: DataFrame, shape: str, template: str, first: int, most: int = MOST_PAGES) -> DataFrame:
    """List-page addresses from ``first`` up to the highest number linked on the page.

    ``shape`` has the number as group 1; ``template`` holds ``{n}``.  Numbers
    above ``most`` don't count, as they can't be page numbers: those links are
    listed by ``pagination_refused``.
    """
    last = F.array_max(F.filter(_linked_numbers(shape), lambda n: n <= most)).cast("int")
    rows = pages.select("page_id", last.alias("last")).filter(F.col("last") >= first)
    head, tail = template.split("{n}")
    return rows.select("page_id", F.explode(F.sequence(F.lit(first), "last")).alias("n")).select(
        "page_id", "n", F.concat(F.lit(head), F.col("n").cast("string"), F.lit(tail)).alias("page_url")
    )


def pagination_refused(pages: DataFrame, shape: str, most: int = MOST_PAGES) -> DataFrame:
    """``page_id, number``: distinct linked numbers that are too large for a page, as written."""
    written = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(shape), F.lit(1))).alias("number"))
    return written.filter(F.coalesce(F.col("number").try_cast("decimal(38,0)") > most, F.lit(True))).distinct()


def _finish(step: DataFrame, source: str, values: dict[str, Column]) -> DataFrame:
    named = [values.get(f, F.lit("")).alias(f) for f in V.RAW_FIELDS]
    return step.select("page_id", F.lit(source).alias("source"), *named)


def listings_from_table_pages(pages: DataFrame) -> DataFrame:
    step = pages.withColumn("pairs", table_pairs(F.col("html"), F.col("url")))
    found = pick_labels(F.col("pairs"), V.TABLE_LABELS)
    step = step.select("*", *[c.alias(f"f_{n}") for n, c in found.items()])
    step = step.withColumn("loc", P.parse_location_named(F.col("f_location")))
    values = {n: F.col(f"f_{n}") for n in found if n != "location"}
    values |= {
        "url": F.col("url"), "title": page_title(F.col("html"), empty_counts=True), "date": P.extractor_date(F.col("f_date"), F.lit("behej")),
        "city": F.col("loc.city"), "district": F.col("loc.district"), "region": F.col("loc.region"),
    }
    return _finish(step, "behej", values)


def listings_from_icon_pages(pages: DataFrame) -> DataFrame:
    step = pages.withColumn("pairs", icon_pairs(F.col("html")))
    names = {n: n for n in [*V.ICON_FIELDS.values(), "organizerWeb"]}
    found = pick_labels(F.col("pairs"), names)
    step = step.select("*", *[c.alias(f"f_{n}") for n, c in found.items()])
    step = step.withColumn("loc", P.parse_location_place(F.col("f_location")))
    detail = F.coalesce(F.get(blocks(F.col("html"), V.DETAIL_BLOCK), 0), F.lit(""))
    lead = F.regexp_extract(detail, r'(?is)<p\s[^>]*?class="[^"]*\blead\b[^"]*"[^>]*>(.*?)</p>', 1)
    return _finish(step, "ceskybeh", {
        "url": F.col("url"), "title": page_title(F.col("html"), "h3"),
        "date": P.extractor_date(F.col("f_date"), F.lit("ceskybeh")),
        "city": F.col("loc.city"), "startPlace": F.col("loc.start_place"), "region": F.col("loc.region"),
        "distance": P.strip_label(F.col("f_distance"), "Délka tratí"), "surface": P.strip_label(F.col("f_raceType"), "Typ závodu"),
        "startTime": P.first_clock(F.col("f_startTime")), "description": inner_text(lead),
        "website": F.coalesce(null_if_empty(F.col("f_website")), F.col("f_organizerWeb")),
        "contact": P.contact_extract(F.col("f_organizer")),
    })


def listings_from_term_pages(pages: DataFrame) -> DataFrame:
    step = pages.withColumn("pairs", term_pairs(F.col("html")))
    found = pick_labels(F.col("pairs"), V.TERM_LABELS)
    step = step.select("*", *[c.alias(f"f_{n}") for n, c in found.items()])
    step = step.withColumn("begin", P.split_place_time(F.col("f_start"))).withColumn("signup", P.split_place_time(F.col("f_registration")))

    def social(kind):
        tag = F.regexp_extract("html", rf'(?is)<a\s[^>]*race-social-links__item--{kind}[^>]*>', 0)
        return F.regexp_extract(tag, r'(?i)href="([^"]*)"', 1)

    about = F.regexp_extract("html", r'(?is)class="[^"]*w-lg-75[^"]*"[^>]*>.*?<p(?:\s[^>]*)?>(.*?)</p>', 1)
    values = {n: F.col(f"f_{n}") for n in ("region", "distance", "surface", "cup", "edition", "rewards", "contact", "feePreRegistration", "feeOnSite")}
    values |= {
        "url": F.col("url"), "title": page_title(F.col("html")), "date": P.extractor_date(F.col("f_date"), F.lit("svetbehu")),
        "city": F.col("f_venue"), "startPlace": F.col("begin.place"), "startTime": F.col("begin.time"),
        "registrationPlace": F.col("signup.place"), "registrationTime": F.col("signup.time"),
        "website": social("web"), "facebook": social("facebook"), "description": inner_text(about),
    }
    return _finish(step, "svetbehu", values)
