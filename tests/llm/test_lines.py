"""Line dedup against brute force."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from paceline.llm import lines


def brute(rows, least=20, documents=3):
    """(n_lines, n_dropped, kept text, bitmap) of each (id, text) row."""
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    none_first = lambda i: (i is not None, i or 0)
    last = {k: max(ids, key=none_first) for k, ids in held.items() if len(k) >= least and len(ids) >= documents}
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        lost = [key(x) in last and last[key(x)] != i for x in own]
        bitmap = "".join(f"{len(list(g))}{'-' if k else '+'}" for k, g in itertools.groupby(lost))
        out.append((i, len(own), sum(lost), "\n".join(x for x, gone in zip(own, lost, strict=True) if not gone), bitmap))
    return out


LONG = "This line of text is repeated across documents"
CASES = [
    (1, LONG), (2, f"a\n  {LONG.upper()}\t\r\nb"), (3, f"{LONG}\n{LONG}\n\n{LONG} "), (4, None), (5, ""), (6, "\n"), (None, LONG), (None, f"x\n{LONG}"),
    (7, "short line"), (8, "short line"), (9, "short line"), (10, "žluťoučký kůň úpěl ďábelské ódy"), (11, "ŽLUŤOUČKÝ KŮŇ ÚPĚL ĎÁBELSKÉ ÓDY"),
    (12, "žluťoučký kůň úpěl ďábelské ódy"), (13, "žluťoučký KŮŇ úpěl ďábelské ÓDY"), (14, "žluťoučký kůň Úpěl ďábelské ódy"),
    (15, "žluťoučký kůň úpěl ďábelské ódy"), (16, "žluťoučký kůň úpěl ďábelské ódy "), (20, "a" * 19), (21, "a" * 19), (22, "a" * 19),
    (30, "b" * 20), (31, f"{'b' * 20}\n{'b' * 20}"), (32, "b" * 20), (32, "b" * 20), (32, f"{'B' * 20}\nother words of the same id"),
    (40, "only in two documents, then kept"), (41, "only in two documents, then kept"), (50, " " * 5000 + "é" + " " * 5000 + "end"),
    (60, "\n".join([LONG, "one", LONG, LONG, "two", "three"] * 400)), (61, "last\x00of all \x85 lines are these\n" + LONG),
]


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.withColumns({"kept": F.lit("x"), "starts": F.lit(1), "id": F.lit("y"), "version": F.lit(0)})
    out = lines.dedup_lines(df, **how).collect()
    assert all(r.row.kept == "x" and r.row.doc_id == r.id for r in out)
    return sorted(((r.id, r.n_lines, r.n_dropped, r.kept, r.bitmap) for r in out), key=str)


def test_lines_of_all_kinds(spark):
    assert run(spark, CASES) == sorted(brute(CASES), key=str)
    assert run(spark, CASES, least_chars=1, least_documents=2) == sorted(brute(CASES, 1, 2), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_random_lines(spark, seed):
    rng = random.Random(seed)
    pool = [f"{'line number ' * rng.randrange(4)}{i % 9}" for i in range(30)]
    rows = [(rng.randrange(60), "\n".join(rng.choices(pool, k=rng.randrange(12)))) for _ in range(150)]
    assert run(spark, rows, least_chars=12) == sorted(brute(rows, 12), key=str)


def test_one_line_in_every_document(spark):
    rows = [(i, f"{LONG}\ndocument {i} is about nothing else") for i in range(3000)]
    out = run(spark, rows)
    assert sum(r[2] for r in out) == 2999 and [r for r in out if r[0] == 2999][0][2] == 0


def test_report_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, "a\nb")], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.line_report(lines.dedup_lines(df)).collect()}
    assert (got[1].n_lines, got[1].kept_sha256) == (1, hashlib.sha256(b"").hexdigest()) and got[2].bitmap == "2+"
    assert lines.dedup_lines(df.limit(0)).count() == 0
    text_ids = spark.createDataFrame([(i, LONG) for i in "abc"], "doc_id string, text string")
    assert {r.id: r.n_dropped for r in lines.dedup_lines(text_ids).collect()} == {"a": 1, "b": 1, "c": 0}
