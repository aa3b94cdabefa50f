"""Plain Python versions of the operators, for small tables."""

import datetime
import hashlib
import math
import re

SPACED = re.compile(rb"[^\x20\x09-\x0d]+")
PLAIN = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text, rule=SPACED):
    return rule.findall((text or "").encode().lower())


def shingle_set(text, n):
    w = words(text)
    if not w:
        return frozenset()
    n = min(n, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def components(rows, n, percent=80):
    """{id: component} of (id, text) rows; rows with one id are one document."""
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingle_set(t, n)) for i, t in rows]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def leaks(text, items, window=10):
    """(words, hit flags, item ids) of a text."""
    w = words(text, PLAIN)
    hit, found = [False] * len(w), set()
    for item, t in items:
        v = words(t, PLAIN)
        n = min(window, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in wins:
                found.add("" if item is None else str(item))
                hit[i : i + n] = [True] * n
    return w, hit, found


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found)


def spans_sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


def jump(key, shards):
    key %= 1 << 64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


class Ctw:
    """Context-tree weighting, one dictionary node at a time."""

    def __init__(self, streams, depth):
        self.depth, self.counts, self.children, self.memo = depth, {}, {}, {}
        for s in streams:
            for ctx, sym in self.places(s):
                for node, bit in self.bits(sym):
                    for d in range(depth + 1):
                        key = (ctx[depth - d :], node)
                        self.counts.setdefault(key, [0, 0])[bit] += 1
                        if d:
                            self.children.setdefault((ctx[depth - d + 1 :], node), set()).add(key)

    def places(self, s):
        padded = b"\n" * self.depth + s
        return [(padded[i : i + self.depth], c) for i, c in enumerate(s)]

    @staticmethod
    def bits(sym):
        return [((1 << j) | (sym >> (8 - j)), (sym >> (7 - j)) & 1) for j in range(8)]

    def kt(self, key):
        a, b = self.counts.get(key, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(self, key):
        if key not in self.memo:
            if len(key[0]) == self.depth:
                self.memo[key] = self.kt(key)
            else:
                kt, below = self.kt(key), sum(self.weighted(c) for c in self.children.get(key, ()))
                top = max(kt, below)
                self.memo[key] = top + math.log((math.exp(kt - top) + math.exp(below - top)) / 2)
        return self.memo[key]

    def score(self, s):
        total = 0.0
        for ctx, sym in self.places(s):
            for node, bit in self.bits(sym):
                p = None
                for d in range(self.depth, -1, -1):
                    key = (ctx[self.depth - d :], node)
                    n = self.counts.get(key, (0, 0))
                    own = (n[bit] + 0.5) / (sum(n) + 1)
                    stop = 1.0 if p is None else math.exp(self.kt(key) - math.log(2) - self.weighted(key))
                    p = own if p is None else stop * own + (1 - stop) * p
                total += math.log10(p)
        return total


# -- pseudonyms: two halves that take turns in being shifted by a digest of the other ---------

def _half(key, kind, i, half):
    return hashlib.sha256(f"{key}|{kind}|{i}|{half}".encode()).hexdigest()


def permuted_number(value, high, low, key, kind):
    a, b = divmod(value, low)
    for i in range(8):
        if i % 2 == 0:
            a = (a + int(_half(key, kind, i, b)[:12], 16)) % high
        else:
            b = (b + int(_half(key, kind, i, a)[:12], 16)) % low
    return a * low + b


def permuted_text(value, key, kind):
    def moved(half, digest):
        out = ""
        for p, c in enumerate(half):
            k = int(digest[2 * (p % 32) : 2 * (p % 32) + 2], 16)
            for first, size in (("0", 10), ("a", 26), ("A", 26)):
                if c.isascii() and 0 <= ord(c) - ord(first) < size:
                    c = chr(ord(first) + (ord(c) - ord(first) + k) % size)
                    break
            out += c
        return out

    a, b = value[: len(value) // 2], value[len(value) // 2 :]
    for i in range(8):
        if i % 2 == 0:
            a = moved(a, _half(key, kind, i, b))
        else:
            b = moved(b, _half(key, kind, i, a))
    return a + b


def pseudonym(value, kind, key):
    if kind == "email":
        name, _, host = value.partition("@")
        return permuted_text(name, key, kind) + "@" + host
    if kind == "phone":
        country = re.match(r"(?:\+[0-9]{1,3}?(?=[ -]|\(|[0-9]{7}))?", value).group()
        return country + permuted_text(value[len(country) :], key, kind)
    if kind == "ip":
        number = 0
        for part in value.split("."):
            number = number * 256 + int(part)
        number = permuted_number(number, 65536, 65536, key, kind)
        return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
    if kind in ("iso_date", "day_date"):
        sep = re.search("[-./]", value).group()
        y, m, d = map(int, value.split(sep) if kind == "iso_date" else reversed(value.split(sep)))
        first = datetime.date(1800, 1, 1)
        to = first + datetime.timedelta(permuted_number((datetime.date(y, m, d) - first).days, 189, 773, key, "date"))
        return to.isoformat() if kind == "iso_date" else f"{to.day:02}{sep}{to.month:02}{sep}{to.year:04}"
    if kind == "ssn":
        area, group, serial = map(int, value.split("-"))
        areas = [a for a in range(1, 900) if a != 666]
        n = permuted_number((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, kind)
        return f"{areas[n // 9999 // 99]:03}-{n // 9999 % 99 + 1:02}-{n % 9999 + 1:04}"
    digits = permuted_text(re.sub("[ -]", "", value)[:-1], key, "card")
    total = sum(int(c) if p % 2 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for p, c in enumerate(reversed(digits)))
    digits, out = iter(digits + str(-total % 10)), ""
    for c in value:
        out += next(digits) if c.isdigit() else c
    return out


def stream(text):
    return b" ".join(words(text)) + b"\n"
