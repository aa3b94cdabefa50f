"""Row-at-a-time statement of the grouping and merging rules, for comparison only."""

ORDER = ["road", "mixed", "cross", "trail", "obstacle"]


def tokens(text):
    return {t for t in text.split() if len(t) > 1}


def similar(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def group(items, norm, url_key):
    """items in load order -> list of lists of items, in group order."""
    by_url, by_key = {}, {}
    for it in items:
        key = url_key(it["website"]) if it["website"] else ""
        if key:
            by_url.setdefault((key, it["date"]), []).append(it)
        else:
            by_key.setdefault((norm(it["title"]), it["date"], norm(it["city"])), []).append(it)
    rest = [(k, v) for k, v in by_key.items()]
    out = []
    while rest:
        (name, date, city), rows = rest.pop(0)
        rows, left = list(rows), []
        for (n, d, c), more in rest:
            ta, tb = tokens(city), tokens(c)
            if d == date and similar(tokens(name), tokens(n)) >= 0.6 and (not ta or not tb or ta & tb):
                rows += more
            else:
                left.append(((n, d, c), more))
        rest = left
        out.append(rows)
    return list(by_url.values()) + out


def first(values):
    return next((v for v in values if v is not None), None)


def merge(rows, organizer_of):
    def longest(vals):
        vals = [v for v in vals if v.strip()]
        return max(vals, key=len) if vals else ""

    cities = [r["city"] for r in rows if r["city"].strip()]
    kept = []
    for r in rows:
        for label, km in r["distances"]:
            hit = next((k for k in kept if abs(k[1] - km) < 0.5), None)
            if hit is None:
                kept.append([label, km])
            elif len(label) > len(hit[0]):
                hit[0] = label
    lows = [r["priceFrom"] for r in rows if r["priceFrom"] is not None]
    highs = [r["priceTo"] for r in rows if r["priceTo"] is not None]
    preferred = next((r for r in rows if r["source"] == "behej"), None)
    organizer = organizer_of(preferred["contact"]) if preferred else None
    return {
        "name": longest([r["title"] for r in rows]),
        "description": longest([r["description"] for r in rows]) or None,
        "date_start": rows[0]["date"],
        "time_start": first(r["startTime"] for r in rows),
        "city": min(cities, key=len) if cities else "",
        "region": first(r["region"] or None for r in rows),
        "distances": sorted([tuple(k) for k in kept], key=lambda k: -k[1]),
        "terrain": max((r["terrain"] for r in rows), key=ORDER.index),
        "price_from": min(lows) if lows else None,
        "price_to": max(highs) if highs else None,
        "website": first(r["website"] for r in rows),
        "source": ",".join(sorted({r["source"] for r in rows})),
        "organizer": organizer or first(organizer_of(r["contact"]) for r in rows),
    }


def finish(races, slug_base):
    counts, slugs = {}, {}
    for r in races:
        if r["website"]:
            counts[r["website"]] = counts.get(r["website"], 0) + 1
    for r in races:
        r["official_url"] = r["website"] if counts.get(r["website"]) == 1 else None
        base = slug_base(r["name"], r["date_start"])
        slugs[base] = slugs.get(base, 0) + 1
        r["slug"] = base if slugs[base] == 1 else f"{base}-{slugs[base]}"
    return races
