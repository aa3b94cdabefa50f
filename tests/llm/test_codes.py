"""Vector code compression against brute force."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label string"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """({(vec_id, label): [(code, error), ..]}, codebooks) in Python's whole numbers."""
    good = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max([1, *(-(-len(v) // parts) for _, v, _ in good)])
    whole = [(i, [math.floor(Fraction(x) * scale) for x in v] + [0] * (width * parts - len(v)), label, v) for i, v, label in good]
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    books = [[cut(v)[p] for _, v, _, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest(part, book):
        return min(range(len(book)), key=lambda e: (far(part, book[e]), e))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for _, v, _, _ in whole:
                own.setdefault(nearest(cut(v)[p], book), []).append(cut(v)[p])
            for e, points in own.items():
                book[e] = tuple(sum(c) // len(points) for c in zip(*points, strict=True))
    out = []
    for i, v, label, _ in whole:
        at = [nearest(s, books[p]) for p, s in enumerate(cut(v))]
        out.append((i, label, "".join(f"{e:02x}" for e in at), sum(far(s, books[p][e]) for p, (s, e) in enumerate(zip(cut(v), at, strict=True)))))
    return out, books


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"row": F.lit("x"), "code": F.lit(1), "part": F.lit(2), "v": F.lit(0)})
    found = codes.compress_vectors(df, **how)
    want, books = brute(rows, **how)
    long = lambda x: x if x is not None and x < 1 << 63 else None
    totals = {}
    for _, label, _, error in want:
        totals[label] = None if long(error) is None or totals.get(label, 0) is None else totals.get(label, 0) + error
    got = [(r.vec_id, r.label, r.code, r.error, r.label_error) for r in found.codes.collect()]
    assert sorted(got, key=str) == sorted([(i, label, c, long(e), long(totals[label])) for i, label, c, e in want], key=str)
    assert found.books == [[list(e) for e in b] for b in books]
    assert found.sha256 == hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return found


def test_codes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.05).tolist(), f"l{i % 4}" if i % 5 else None) for i in range(300)]
    rows += [(400 + i, rows[7][1], "copy") for i in range(60)] + [(3, rows[9][1], "again"), (None, rows[1][1], "l1"), (None, rows[2][1], "l1")]
    rows += [(500, None, "l1"), (501, [1.0, None] * 8, "l1"), (502, [float("nan")] * 16, "l2"), (503, [float("inf")] * 16, None)]
    found = check(spark, rows)
    shown = found.codes.select("vec_id", "label", found.decoded(F.col("code")).alias("v"), "error").filter("vec_id = 42").first()
    cut = [math.floor(x * 4096) / 4096 for x in rows[42][1]]
    assert shown.error == round(sum((a - b) ** 2 for a, b in zip(cut, shown.v, strict=True)) * 4096**2)
    monkeypatch.setattr(codes, "BLOCK", 7)
    check(spark, rows, entries=5, rounds=2, parts=4)


def test_shapes_and_sizes(spark):
    rng = np.random.default_rng(6)
    ragged = [(i, rng.normal(size=int(rng.integers(0, 21))).tolist(), "a") for i in range(40)]
    check(spark, ragged, rounds=3)
    check(spark, [(1, [0.5] * 8, None), (2, [-0.25] * 8, None)])
    large = [(i, (rng.normal(size=8) * 10.0 ** rng.integers(0, 12, 8)).tolist(), "a") for i in range(60)]
    check(spark, large + [(100, [1e300] + [0.0] * 7, "b"), (101, [-1.5e16] * 8, "c"), (102, [2.0**70] * 8, "c")], rounds=2)
    none = codes.compress_vectors(spark.createDataFrame([(1, None, "a")], SCHEMA))
    assert none.codes.count() == 0 and none.books == [[]] * 8
    assert codes.compress_vectors(spark.createDataFrame([], SCHEMA)).codes.count() == 0


def test_one_very_common_vector(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [0.1] * 8 if i % 3 else rng.normal(size=8).tolist(), "a") for i in range(900)]
    check(spark, rows, rounds=2)


@pytest.mark.parametrize("dims, bits", [(2, 5), (3, 4), (8, 2), (1, 6)])
def test_hilbert_curve_visits_every_cell_by_steps_of_one(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = codes.hilbert_keys(cells, bits)
    walk = cells[np.argsort(key)]
    assert sorted(key.tolist()) == list(range(len(cells))) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shortlists_hold_every_nearest_entry():
    rng = np.random.default_rng(8)
    for _ in range(200):
        points, book = rng.integers(-9, 9, (20, 3)), rng.integers(-9, 9, (6, 3))
        short = codes.shortlist(points.min(0), points.max(0), book)
        nearest = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
        assert set(nearest.tolist()) <= set(short.tolist())
