import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from paceline import fixed_values as V
from paceline.operators import engage as E
from paceline.operators import upsert as U
from paceline.operators.filters import report_valid, valid_url
from paceline.sources import listings as S
from paceline.sources import pages as G
from paceline.streaming import flows as W

T0 = dt.datetime(2026, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def dataset(tmp_path):
    """Two dataset folders of three; one broken file and one without a title."""
    def put(folder, name, text):
        path = tmp_path / folder / V.DATASET_SUBDIR
        path.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(text, encoding="utf8")

    def item(**kw):
        return json.dumps({**dict.fromkeys(V.RAW_FIELDS, ""), **kw}, ensure_ascii=False, indent=1)

    put("extractor-svetbehu-cz", "000.json", item(title="Běh C", date="1.1.2026", website="c.cz"))
    put("extractor-behej-com", "002.json", item(title="Běh B", date="2026-01-01", city="Brno"))
    put("extractor-behej-com", "001.json", item(title="Běh A", date="3. ledna 2026", feeOnSite="100"))
    put("extractor-behej-com", "003.json", '{"title": "rozbit')
    put("extractor-behej-com", "004.json", item(title=" ", date="2026-01-01"))
    put("extractor-behej-com", "notes.txt", "x")
    return str(tmp_path)


def test_read_sources(spark, dataset):
    good, bad = S.split_corrupt(S.read_listings(spark, dataset))
    assert [r["file_name"] for r in bad.collect()] == ["003.json"]
    rows = S.load_sources(spark, dataset).orderBy("ord").collect()
    assert [(r["source"], r["title"]) for r in rows] == [("behej", "Běh A"), ("behej", "Běh B"), ("svetbehu", "Běh C")]


def test_ingest_flow_loses_no_row(spark, dataset, tmp_path):
    out, aside = str(tmp_path / "o"), str(tmp_path / "q")
    W.drain_batches(W.raw_stream(spark, dataset, maxFilesPerTrigger=2), W.ingest_flow(out, aside), str(tmp_path / "c"))
    assert {r["title"] for r in spark.read.parquet(out).collect()} == {"Běh A", "Běh B", "Běh C"}
    rows = {r["reason"]: r for r in spark.read.parquet(aside).collect()}
    assert set(rows) == {"unreadable", "incomplete"} and rows["unreadable"]["raw"].startswith('{"title": "rozbit')
    assert len({r["batch"] for r in spark.read.parquet(out).select("batch").collect()}) >= 1


def test_stream_ingest_and_upsert(spark, dataset, tmp_path):
    out = W.drain(W.ingest_stream(spark, dataset), str(tmp_path / "o"), str(tmp_path / "c"))
    assert {r["title"] for r in out.collect()} == {"Běh A", "Běh B", "Běh C"}
    schema = ("slug string, name string, description string, date_start date, city string, official_url string, price_from bigint, "
              "capacity int, created_at timestamp, updated_at timestamp")
    table = W.RaceTable(spark, str(tmp_path / "t"), schema)
    W.drain_batches(W.listing_stream(spark, dataset, maxFilesPerTrigger=10), W.upsert_flow(table, "2026-01-05"), str(tmp_path / "c2"))
    rows = {r["slug"]: r for r in table.read(0).collect()}
    assert set(rows) == {"beh-a-2026", "beh-b-2026", "beh-c-2026"} and rows["beh-a-2026"]["price_from"] == 100


def throttle(rows):
    last, out = {}, set()
    for key, i, when in sorted(rows, key=lambda r: (r[2], r[1])):
        if key not in last or (when - last[key]).total_seconds() >= 60:
            last[key] = when
            out.add(i)
    return out


def test_stream_throttle_over_batches(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows, clock = [], 0
    for i in range(90):
        clock += rng.choice([0, 5, 20, 59, 60, 61])
        rows.append((rng.randint(1, 3), i, at(clock)))
    for n in range(3):
        part = spark.createDataFrame(rows[n * 30:(n + 1) * 30], "race_id long, id long, created_at timestamp")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = W.folder_stream(spark, "race_id long, id long, created_at timestamp", str(tmp_path / "in"), maxFilesPerTrigger=1)
    got = W.drain(W.throttle_stream(stream, watermark="1 hour"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert {r["id"] for r in got.collect()} == throttle(rows)


def test_batch_throttle_equals_row_at_a_time(spark):
    import random

    from paceline.operators.throttle import throttle as batch_throttle

    rng = random.Random(6)
    rows, clock = [], 0
    for i in range(1500):
        clock += rng.choice([0, 0, 1, 3, 20, 59, 60, 61, 130] if i % 300 else [4000])
        rows.append((1 if i % 3 else rng.randint(1, 4), i, at(clock)))
    df = spark.createDataFrame(rows, "race_id long, id long, created_at timestamp")
    assert {r["id"] for r in batch_throttle(df).collect()} == throttle(rows)


def test_anti_recent_equals_brute_force(spark):
    import random

    rng = random.Random(8)
    new = [(i, rng.randint(1, 2), at(rng.randint(0, 900))) for i in range(40)]
    old = [(rng.randint(1, 2), at(rng.randint(0, 900))) for _ in range(25)]
    got = E.anti_recent(spark.createDataFrame(new, "id long, race_id long, created_at timestamp"),
                        spark.createDataFrame(old, "race_id long, created_at timestamp"))
    want = {i for i, k, t in new if not any(k == k2 and dt.timedelta(0) <= t - t2 < dt.timedelta(seconds=60) for k2, t2 in old)}
    assert {r["id"] for r in got.collect()} == want


SCHEMA = "id long, race_id long, user_id long, referred_by long, created_at timestamp"


def test_interest(spark):
    rows = [(1, 1, 7, None, at(0)), (2, 1, 7, None, at(1)), (3, 1, None, None, at(2)), (4, 1, None, None, at(2)), (5, 2, 7, 9, at(3))]
    df = spark.createDataFrame(rows, SCHEMA)

    def ids(d):
        return {r["id"] for r in d.collect()}

    assert ids(E.unique_interest(df)) == {1, 3, 4, 5}
    stored = spark.createDataFrame([(0, 2, 7, None, at(0))], SCHEMA)
    assert ids(E.append_interest(stored, df)) == {1, 3, 4}
    assert ids(E.remove_interest(df, stored)) == {1, 2, 3, 4}
    assert E.referral_rows(df).first()["referrer_id"] == 9


def test_unique_interest_stream_is_exact_over_batches(spark, tmp_path):
    rows = [(1, 1, 7, None, at(0)), (2, 1, 7, None, at(9000)), (3, 1, None, None, at(9001))]
    for row in rows:
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.createDataFrame(rows, SCHEMA).schema
    stream = W.folder_stream(spark, schema, str(tmp_path / "in"), maxFilesPerTrigger=1)
    W.keep_state_by_key(spark)
    once = W.drain(W.unique_interest_stream(stream, None), str(tmp_path / "out"), str(tmp_path / "c"))
    assert {r["id"] for r in once.collect()} == {1, 3}
    bounded = W.drain(W.unique_interest_stream(stream, "1 day"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert bounded.count() == 2


def test_a_batch_of_unique_interest_reads_its_own_rows_only(spark, tmp_path):
    """Thousands of pairs are known; a batch of one row reads one row and what it looks up, as it did at first."""
    W.keep_state_by_key(spark)
    schema = spark.createDataFrame([], SCHEMA).schema
    (tmp_path / "in").mkdir()
    stream = W.folder_stream(spark, schema, str(tmp_path / "in"), maxFilesPerTrigger=1)
    batches = [[(0, 0, 1, None, at(0))], [(i, i, 1, None, at(i)) for i in range(1, 8000)], [(9000, 5, 1, None, at(9000))], [(9001, 5, 2, None, at(9001))]]
    read = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = W.unique_interest_stream(stream, None).writeStream.format("parquet").option("path", str(tmp_path / "o")).option(
            "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        ran = [p for p in query.recentProgress if p["numInputRows"]]
        read.append((sum(p["numInputRows"] for p in ran), sum(o["customMetrics"].get("rocksdbTotalBytesRead", 0) for p in ran for o in p["stateOperators"])))
    # The two branches (known and anonymous users) may each read the batch's file, none reads an earlier one.
    assert all(len(rows) <= n <= 2 * len(rows) for (n, _), rows in zip(read, batches, strict=True))
    assert read[2][1] <= 4096 and read[3][1] <= 4096
    assert spark.read.parquet(str(tmp_path / "o")).count() == 8001


RACES = "slug string, name string, official_url string, created_at timestamp, updated_at timestamp"


def test_bucketed_table_rewrites_what_a_batch_touches(spark, tmp_path):
    rows = [(f"s{i}", "old", f"https://r{i}.cz" if i % 2 else None, T0, T0) for i in range(60)]
    table = W.RaceTable(spark, str(tmp_path / "t"), RACES, buckets=16)
    table.create(spark.createDataFrame(rows, RACES))
    want, batch_schema = spark.createDataFrame(rows, RACES), "slug string, name string, official_url string"

    def written(kind, n):
        folder = tmp_path / "t" / kind / f"v{n}"
        return [p.name for p in folder.iterdir() if p.name.startswith("bucket=")] if folder.exists() else []

    batches = [[("s5", "new", "https://r5.cz")], [("moved", "new", "https://r7.cz"), ("s8", "x", "https://new.cz"), ("add", "new", "https://add.cz")],
               [("s9", None, None), ("moved", "again", "https://r7.cz")]]
    for n, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, batch_schema)
        want, bad = U.upsert_races(want, batch, "2026-02-01")
        want = spark.createDataFrame(want.collect(), RACES)
        table.upsert(batch, n, "2026-02-01")
        once = sorted(map(tuple, table.read(n).collect()), key=str)
        assert once == sorted(map(tuple, want.collect()), key=str)
        if n == 1:  # a repeated micro-batch
            table.upsert(batch, n, "2026-02-01")
            assert sorted(map(tuple, table.read(n).collect()), key=str) == once
        refused = spark.read.parquet(str(tmp_path / "t" / "rejected" / f"batch={n}"))
        assert sorted(r.slug for r in refused.collect()) == sorted(r.slug for r in bad.collect())
    assert len(written("slug", 0)) == 1 and written("url", 0) == []
    index = table._open("url", table._list(2))
    assert sorted(map(tuple, index.collect())) == sorted((r.official_url, r.slug) for r in want.filter("official_url IS NOT NULL").collect())


def test_upsert(spark):
    table = spark.createDataFrame(
        [("a", "old", "keep", "https://x.cz", T0, T0), ("b", "old", "keep", None, T0, T0), ("c", "old", "keep", None, T0, T0)],
        "slug string, name string, cover string, official_url string, created_at timestamp, updated_at timestamp")
    batch = spark.createDataFrame(
        [("a2", "new", "https://x.cz"), ("b", None, None), ("d", "new", None)], "slug string, name string, official_url string")
    after, rejected = U.upsert_races(table, batch, "2026-02-01")
    rows = {r["slug"]: r for r in after.collect()}
    assert rejected.count() == 0
    assert set(rows) == {"a2", "b", "c", "d"}
    assert (rows["a2"]["name"], rows["a2"]["cover"], rows["a2"]["created_at"]) == ("new", "keep", T0)
    assert rows["b"]["name"] is None and rows["b"]["updated_at"] > T0
    assert rows["c"]["updated_at"] == T0 and rows["d"]["cover"] is None
    twice = batch.unionByName(spark.createDataFrame([("d", "x", "https://y.cz")], batch.schema))
    assert sorted((r["slug"], r["reason"] or "") for r in U.judge_batch(table, twice).collect()) == [
        ("a2", ""), ("b", ""), ("d", "slug repeated"), ("d", "slug repeated")]


def test_upsert_never_doubles_a_slug(spark):
    """A stored race without address gains one: its slug is taken, so the row fails as a unique key would make it."""
    table = spark.createDataFrame([("s", "old", None, T0, T0), ("t", "old", "https://t.cz", T0, T0)],
                                  "slug string, name string, official_url string, created_at timestamp, updated_at timestamp")
    batch = spark.createDataFrame([("s", "new", "https://s.cz"), ("t", "new", "https://u.cz"), ("u", "x", "https://v.cz"), ("w", "x", "https://v.cz")],
                                  "slug string, name string, official_url string")
    after, rejected = U.upsert_races(table, batch, "2026-02-01")
    assert sorted((r["slug"], r["name"]) for r in after.collect()) == [("s", "old"), ("t", "old")]
    assert {(r["slug"], r["reason"]) for r in rejected.collect()} == {
        ("s", "slug taken"), ("t", "slug taken"), ("u", "address repeated"), ("w", "address repeated")}


def test_small_predicates(spark, evaluate):
    assert evaluate(valid_url, "https://a.cz/x", " HTTP://a.cz ", "ftp://a.cz", "a.cz", "", None) == [True, True, False, False, False, False]
    df = spark.createDataFrame([(1, ["a"], None), (2, [], "x"), (3, [], ""), (4, [], None)], "id int, reasons array<string>, message string")
    assert {r["id"] for r in df.filter(report_valid()).collect()} == {1, 2}


def test_pages(spark, evaluate):
    html = "<title> T &amp; U </title><h1><b></b></h1>"
    assert evaluate(G.page_title, html, "<h1 class='a'>Nadpis <i>x</i></h1><title>t</title>") == ["T & U", "Nadpis x"]
    assert evaluate(G.absolute_url, ("https://a.cz/x/y?q#f", "z"), ("https://a.cz", "/r"), ("https://a.cz/x", "//b.cz"),
                    ("https://a.cz/x", "mailto:a"), ("https://a.cz/x?y", "#t")) == [
        "https://a.cz/x/z", "https://a.cz/r", "https://b.cz", "mailto:a", "https://a.cz/x#t"]
    assert evaluate(lambda h: G.page_title(h, empty_counts=True), html, "<title>t</title>") == ["", "t"]
    page = spark.createDataFrame([(1, "https://a.cz/list/", '<a href="/list/beh/">1</a><a href="/list/strana/3/">3</a><a href="/list/a/b/">n</a>')],
                                 "page_id long, url string, html string")
    links = G.link_extract(page, "https://a.cz/list/*/", "https://a.cz/list/strana/**")
    assert [r["target"] for r in links.collect()] == ["https://a.cz/list/beh/"]
    more = G.pagination_expand(page, r"/strana/(\d+)/", "https://a.cz/list/strana/{n}/", 2)
    assert [r["page_url"] for r in more.orderBy("n").collect()] == ["https://a.cz/list/strana/2/", "https://a.cz/list/strana/3/"]
    huge = spark.createDataFrame([(1, "u", "/strana/2/ /strana/2147483000/ /strana/" + "9" * 60 + "/"), (2, "u", "/strana/2147483647/")], page.schema)
    assert [r["n"] for r in G.pagination_expand(huge, r"/strana/(\d+)/", "x{n}", 1).orderBy("n").collect()] == [1, 2]
    assert {(r.page_id, r.number) for r in G.pagination_refused(huge, r"/strana/(\d+)/").collect()} == {
        (1, "2147483000"), (1, "9" * 60), (2, "2147483647")}


def test_blocks_end_where_their_own_tag_closes(spark, evaluate):
    found = evaluate(lambda h: G.blocks(h, "a", "b"), '<div class="b x a">1<div>2<DIV class="q">3</div></div>4</div>5<div class="a b"><!-- </div> -->6</div>',
                     '<div class="ab a-b">no</div><div class="a b">open <div>x</div> end', "<p>none</p>", None, '<div class="a b">one<div class="b a">two</div>three</div>')
    assert found == [['1<div>2<DIV class="q">3</div></div>4', "6"], ["open <div>x</div> end"], [], None, ["one", "two"]]


def test_icons_count_inside_the_detail_block_only(spark):
    html = ('<div class="col-md-12 text-muted"><p><i class="fa-road"></i>out</p></div><div class="race-detail"><p class="lead">Popis <b>trati</b></p>'
            '<p><i class="fa-clock"></i>9:00</p><div class="col-md-12 text-muted"><div><p>10 km <i class="fa fa-arrows-h"></i></p></div><p>no icon</p></div></div>'
            '<p class="lead">other</p>')
    row = G.listings_from_icon_pages(spark.createDataFrame([(1, "https://c.cz/1", html)], "page_id long, url string, html string")).first()
    assert (row.distance, row.surface, row.startTime, row.description) == ("10 km", "", "", "Popis trati")


def test_growth(spark):
    events = spark.createDataFrame([(1, "view", at(0)), (1, "signup", at(1)), (2, "signup", at(0)), (2, "view", at(1)), (1, "click", at(0))],
                                   "user_id long, event_type string, ts timestamp")
    got = {r["name"]: (r["users"], r["rate"]) for r in E.funnel_rates(events).collect()}
    assert got == {"view": (2, None), "signup": (1, 0.5), "click": (0, 0.0), "purchase": (0, None)}


def test_funnel_equals_row_at_a_time(spark):
    import random

    rng, steps = random.Random(2), ("view", "signup", "click", "purchase")
    rows = [(rng.randrange(30), rng.choice([*steps, "other"]), at(rng.choice([0, 5, 5, 700, 1300]) * rng.randrange(9))) for _ in range(900)]
    rows += [(99, steps[i % 4], at(i)) for i in range(3000)] + [(None, "view", at(0)), (98, "view", None)]
    reached = {}
    for user in {u for u, _, t in rows if u is not None and t is not None}:
        own, since = [(t, e) for u, e, t in rows if u == user], dt.datetime.min
        for i, name in enumerate(steps):
            times = [t for t, e in own if e == name and t is not None and t >= since]
            if not times:
                break
            since = min(times)
            reached[i] = reached.get(i, 0) + 1
    df = spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp")
    for slot in (60, 600):
        got = {r["step"]: r["users"] for r in E.funnel_rates(df, slot_seconds=slot).collect()}
        assert got == {i: reached.get(i, 0) for i in range(4)}


def test_throttle_state_ends_behind_the_watermark(spark, tmp_path):
    """Address keys; an old key's state goes once time has moved on, and its next report is accepted."""
    rows = [("a", 1, at(0)), ("a", 2, at(30)), ("b", 3, at(40)), ("b", 4, at(7200)), ("a", 5, at(7201)), ("a", 6, at(7230)), ("b", 7, at(14400))]
    schema = "address string, id long, created_at timestamp"
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = W.folder_stream(spark, spark.createDataFrame([], schema).schema, str(tmp_path / "in"), maxFilesPerTrigger=1)
    got = W.drain(W.throttle_stream(stream, "address", "1 minute"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert {(r["key"], r["id"]) for r in got.collect()} == {("a", 1), ("b", 3), ("b", 4), ("a", 5), ("b", 7)}


def test_stretches_of_a_stream_are_computed_in_parallel(spark, tmp_path):
    from paceline.catalog import engagement

    rows = spark.range(0, 400, 1, 4).withColumn("part", F.spark_partition_id())
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    batches = []
    W.drain_batches(engagement._stream_of(spark, rows, "id"), lambda b, n: batches.append(b.agg(F.count("id"), F.max("id")).first()), checkpoint)
    assert len(batches) == 3 and sum(b[0] for b in batches) == 400 and [b[1] for b in batches] == sorted(b[1] for b in batches)
    back = W.drain(engagement._stream_of(spark, rows, "id"), out, checkpoint + "-2")
    assert back.select("part").distinct().count() == 4


def test_page_is_searched_once_for_its_pairs(spark):
    term = '<div class="terms__note">A</div><div class="terms__text">1 <a>x</a></div><p>-</p><div class="terms__note">B</div> <div class="terms__text">2</div>'
    table = '<table class="race"><tr><td>A:</td><td>1</td></tr><tr><td>B</td><td><a href="/z">2</a></td></tr></table>'
    pages = spark.createDataFrame([(1, "https://a.cz/", term, table)], "page_id long, url string, term string, tab string")
    found = pages.select(G.term_pairs(F.col("term")).alias("t"), G.table_pairs(F.col("tab"), F.col("url")).alias("r"))
    row = found.first()
    assert [tuple(p) for p in row.t] == [("a", "x"), ("b", "2")] and [tuple(p) for p in row.r] == [("a", "1"), ("b", "https://a.cz/z")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(term") == 2 and plan.count("regexp_extract(tab") == 1
