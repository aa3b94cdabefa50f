import random
import re
import unicodedata

import pytest
from oracle import finish, group, merge
from pyspark.sql import functions as F

from paceline import fixed_values as V
from paceline.operators import merge as M
from paceline.operators import normalize as N
from paceline.operators import resolve as R
from paceline.operators.components import component_labels
from paceline.operators.ordering import numbered_within
from paceline.plans.integrate import integrate, stage_counters

RAW = "ord long, source string, " + ", ".join(f"{c} string" for c in V.RAW_FIELDS)


def norm(text):
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ")
    return re.sub(r"[^a-z0-9]+", " ", plain.lower()).strip()


def url_key(url):
    return re.sub(r"/+$", "", re.sub(r"^www\.", "", re.sub(r"^https?://", "", url.strip().lower())))


def organizer_of(contact):
    hit = re.search(r"Jméno:\s*([^\n]+)", contact)
    return (hit.group(1).strip() or None) if hit else None


def slug_base(name, date):
    return norm(name).replace(" ", "-")[:80] + "-" + date[:4]


def raw_rows(n, seed, dates=3):
    rng = random.Random(seed)
    words = ["Jarní", "běh", "Pávov", "maraton", "noční", "trail", "kolem", "Brna", "a", "X"]
    cities = ["Brno", "Praha 6", "", "Radonice (u Prahy)", "Brno venkov", "Frýdek-Místek"]
    rows = []
    for i in range(n):
        row = dict.fromkeys(V.RAW_FIELDS, "")
        row.update(
            url=f"u{i}", title=" ".join(rng.choices(words, k=rng.randint(1, 5))),
            date=f"{rng.randint(1, dates)}. 5. 2026", city=rng.choice(cities), region=rng.choice(["praha", "vysočina", ""]),
            distance=" / ".join(f"{rng.choice([5, 5.2, 5.4, 5.6, 10, 21.1, 21.4, 42])} km{rng.choice(['', ' dlouhá'])}" for _ in range(rng.randint(0, 3))),
            surface=rng.choice(["", "silnice", "terén", "ocr", "jiný"]), startTime=rng.choice(["", "9:00", "10.30"]),
            website=rng.choice(["", "", "", "www.a.cz/", "http://a.cz", f"https://r{i}.cz"]),
            description=rng.choice(["", "popis", "delší popis"]), feeOnSite=rng.choice(["", "100", "zdarma"]),
            feePreRegistration=rng.choice(["", "50", "300"]), contact=rng.choice(["", "Jméno: A\n", "Jméno: B\n"]),
        )
        rows.append((i, rng.choice(["behej", "ceskybeh", "svetbehu"]), *[row[c] for c in V.RAW_FIELDS]))
    return rows


def expected(items):
    rows = [
        {**r.asDict(), "distances": [(d["label"], d["km"]) for d in r["distances"]]}
        for r in sorted(items.collect(), key=lambda r: r["ord"])
    ]
    groups = group(rows, norm, url_key)
    return groups, finish([merge(g, organizer_of) for g in groups], slug_base)


@pytest.mark.parametrize("limits", [
    {}, {"local_nodes": 0, "pair_budget": 50, "local_edges": 1_000_000}, {"local_nodes": 0, "pair_budget": 1e12, "local_edges": 3},
    {"local_nodes": 30, "pair_budget": 400, "local_edges": 5},
])
def test_integrate_equals_row_at_a_time(spark, limits):
    raw = spark.createDataFrame(raw_rows(200, 11), RAW)
    groups, want = expected(N.accepted(N.normalize_items(raw)))
    got = {r["slug"]: r.asDict() for r in integrate(raw, **limits).collect()}
    assert len(got) == len(want)
    for race in want:
        row = got[race["slug"]]
        row["distances"] = [(d["label"], d["km"]) for d in row["distances"]]
        assert {k: row[k] for k in race} == race


def test_groups_are_a_partition(spark):
    raw = spark.createDataFrame(raw_rows(120, 5), RAW)
    items = N.accepted(N.normalize_items(raw))
    keyed, ids = M.resolve_items(items)
    assert ids.count() == ids.select("group_key").distinct().count()
    assert keyed.join(ids, "group_key").count() == items.count()


def test_dense_crowd_needs_no_all_pairs(spark):
    """One date, one city, many near copies: a short head finds the leader."""
    n = 3000
    nodes = spark.range(n).select(
        F.lit("2026-05-01").alias("date"), F.col("id").alias("ord"),
        F.array(*[F.lit(w) for w in "aa bb cc dd ee ff gg hh".split()], F.concat(F.lit("w"), F.col("id").cast("string"))).alias("names"),
        F.array(F.lit("brno")).alias("cities"),
    )
    links = R.leader_links(nodes, pair_budget=2000).collect()
    assert len(links) == n - 1 and {r["a"] for r in links} == {0}


def test_long_dependency_chain(spark):
    """Each node matches only its neighbours: leaders alternate."""
    n = 25
    nodes = spark.range(n).select(
        F.lit("d").alias("date"), F.col("id").alias("ord"),
        F.transform(F.sequence(F.col("id") * 2, F.col("id") * 2 + 7), lambda x: F.concat(F.lit("w"), x.cast("string"))).alias("names"),
        F.array().cast("array<string>").alias("cities"),
    )
    for limits in ({}, {"local_edges": 0}, {"pair_budget": 10}):
        links = {r["b"]: r["a"] for r in R.leader_links(nodes, **limits).collect()}
        assert links == {i: i - 1 for i in range(1, n, 2)}, limits


def greedy(edges):
    """The sequential rule: {absorbed node: leader}."""
    absorbed = {}
    for b in sorted({b for _, b in edges}):
        free = [a for a, x in edges if x == b and a not in absorbed]
        if free:
            absorbed[b] = min(free)
    return absorbed


@pytest.mark.parametrize("local_edges", [0, 4, 30, 10_000])
def test_many_components_on_one_date(spark, monkeypatch, local_edges):
    """Small components share tasks, packed by edges; rounds see only those that are too large themselves."""
    rng, edges, base = random.Random(4), set(), 0
    for size in [2] * 40 + [5] * 12 + [9, 30, 60]:
        for b in range(1, size):
            for a in {rng.randrange(b) for _ in range(2)}:
                edges.add((base + a, base + b))
        base += size
    date = {e: "one" if e[0] < base - 99 or local_edges < 30 else "two" for e in edges}
    df = spark.createDataFrame([(date[e], *e) for e in edges], "date string, a long, b long").repartition(5)
    hard, rounds = [], R._by_rounds
    monkeypatch.setattr(R, "_by_rounds", lambda e, n: hard.append(e.count()) or rounds(e, n))
    got = {r.b: r.a for r in R.solve_edges(df, local_edges).collect()}
    assert got == greedy(edges)
    sizes = {}
    for r in component_labels(df).collect():
        sizes.setdefault(r.comp, set()).add(r.node)
    own = [sum(a in nodes for a, _ in edges) for nodes in sizes.values()]
    large = sum(n for n in own if n > local_edges)
    assert len(sizes) == 55 and hard == ([large] if large else [])


def test_few_jobs_while_building(spark):
    """A date that fits a task needs no match graph: few jobs run before the result is asked for."""
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    raw = spark.createDataFrame(raw_rows(100, 3), RAW)
    before = scheduler.numTotalJobs()
    M.resolve_items(N.accepted(N.normalize_items(raw)))
    assert scheduler.numTotalJobs() - before <= 8


def test_numbering_survives_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", i % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "o long, k string, p int").repartition(7)
    got = numbered_within(df, ["k"], "o", "n", lead=["p"], slices=16)
    seen = {}
    for r in sorted(got.collect(), key=lambda r: (r["k"], r["p"], r["o"])):
        seen[r["k"]] = seen.get(r["k"], 0) + 1
        assert r["n"] == seen[r["k"]]


def test_stage_counters(spark):
    rows = raw_rows(60, 2)
    rows += [(100, "behej", *["x" if c in ("title", "date") else "" for c in V.RAW_FIELDS])]
    rows += [(101, "behej", *[{"title": "x", "date": "1.1.2026", "region": "Slovensko"}.get(c, "") for c in V.RAW_FIELDS])]
    raw = spark.createDataFrame(rows, RAW)
    from paceline.plans.integrate import merged_races

    got = {r["stage"]: r["n"] for r in stage_counters(raw, merged_races(raw)).collect()}
    assert (got["raw"], got["normalized"], got["bad_date"], got["foreign"]) == (62, 60, 1, 1)


def test_rounds_do_not_grow_with_sparse_dates(spark, monkeypatch):
    """2,000 nodes on 200 dates without a match take one round; a dense crowd beside them as many as alone."""
    rounds = []
    dense = R._dense_dates
    monkeypatch.setattr(R, "_dense_dates", lambda *a: rounds.append(1) or dense(*a))
    sparse = [(f"d{i % 200}", [f"n{i}", f"m{i}"], [], i) for i in range(2000)]
    crowd = [("crowd", ["beh", f"x{i % 40}", f"y{i % 40}"], [], 5000 + i) for i in range(120)]
    schema = "date string, names array<string>, cities array<string>, ord long"

    def solved(rows):
        rounds.clear()
        return R.leader_links(spark.createDataFrame(rows, schema), pair_budget=60).count(), len(rounds)

    assert solved(sparse) == (0, 1)
    links, alone = solved(crowd)
    assert alone > 1 and solved(sparse + crowd) == (links, alone)
