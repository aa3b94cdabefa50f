"""Importance resampling against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import resampling
from paceline.llm.common import Staged
from paceline.llm.words import PLAIN, Words

from . import brute


def runs(text, longest):
    w = brute.words(text, brute.PLAIN)
    return [b" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def expected(docs, target, longest=1, buckets=10_000, least=20, percent=10, seed="2024"):
    bucket = lambda f: zlib.crc32(f) % buckets
    s = collections.Counter(bucket(f) for _, t in docs for f in runs(t, longest))
    t = collections.Counter(bucket(f) for x in target for f in runs(x, longest))
    n_s, n_t, out = sum(s.values()), sum(t.values()), []
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    for i, text in docs:
        f = runs(text, longest)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(brute.words(text, brute.PLAIN))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def corpus(n, seed=1):
    rng = random.Random(seed)
    pool = [f"word{i}" for i in range(60)] + ["Žluťoučký", "x" * 200, "ABC", "a-b"]
    docs = [(rng.randrange(-50, 10**6) if i % 9 else -i, " ".join(rng.choices(pool, k=rng.randrange(60)))) for i in range(n)]
    docs = list({i: (i, t) for i, t in docs}.values())
    return docs + [(None, "one two " * 15), (1 << 61, None), (-(1 << 61), ""), (10**7, "y" * 300_000 + " z" * 30), (10**7 + 1, "\x00 é")]


@pytest.mark.parametrize("longest, percent", [(1, 10), (3, 60)])
def test_resampling(spark, longest, percent):
    docs, target = corpus(300), ["word1 word2 word3 word4", None, "Žluťoučký word5", "", "word1 word2"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns({"row": F.lit("x"), "rank": F.lit(1)})
    tf = spark.createDataFrame([(t,) for t in target], "text string")
    out = resampling.resample(df, tf, longest=longest, percent=percent, digit_bits=5, chunk_bits=4).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out), key=str) == expected(docs, target, longest, percent=percent)


def test_empty_tables_and_repeated_rows(spark):
    docs = [(5, "a b " * 15)] * 7 + [(6, "c d " * 20)] * 3
    df, none = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "text string")
    out = resampling.resample(df, none, percent=100).collect()
    assert sorted(r["rank"] for r in out) == list(range(1, 11)) and len({r.score for r in out}) == 2
    ranked = sorted(out, key=lambda r: r["rank"])
    assert [r.score for r in ranked] == sorted((r.score for r in out), reverse=True)
    assert resampling.resample(df.limit(0), none).count() == 0
    few = resampling.resample(df.limit(9), none).collect()  # a tenth of nine documents is none
    assert len(few) == 9 and all(r["rank"] is None for r in few)


def test_radix_places(spark):
    rng = random.Random(3)
    rows = [(i * 3, rng.choice([-(1 << 63), -5, 0, 7, 1 << 40, (1 << 63) - 1]), rng.randrange(-9, 9)) for i in range(700)]
    df = spark.createDataFrame(rows, "row long, a long, b long")
    out = {r.row: r.place for r in resampling.radix_places(df, [F.col("a"), F.col("b")], Staged(spark, "t"), 6, 5).collect()}
    want = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    assert out == {r[0]: place for place, r in enumerate(want)}
    same = spark.createDataFrame([(i * 5, 1) for i in range(50)], "row long, a long")
    assert sorted(r.place for r in resampling.radix_places(same, [F.col("a")], Staged(spark, "t")).collect()) == list(range(50))


def test_checksums_of_words():
    texts = ["", None, "Hello, WORLD " + "q" * 64 + " " + "r" * 65 + " " + "é" * 500, "a"]
    words = Words(texts, PLAIN)
    for k, (begin, crc) in enumerate(resampling.features(words, 3), 1):
        assert sorted(crc.tolist()) == sorted(zlib.crc32(f) for t in texts for f in runs(t, 3) if f.count(b" ") == k - 1)
        assert (np.diff(begin) > 0).all()
