"""Importance resampling towards a target: hashed features weigh documents, a distributed radix sort ranks them."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import Staged, keeping, query, table
from paceline.llm.words import PLAIN, Words, batches, texts_of

#: Feature buckets, longest run of words, least words of a drawn document, per cent drawn, seed of the noise.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
#: Bits of a digit, and of the number of places in a chunk, of the radix sort.
DIGIT_BITS, CHUNK_BITS = 10, 14
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


CRC = _crc_table()


def crc_on(crc: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Checksums ``crc`` of what came before, carried on over the byte ranges [start, stop)."""
    size = stop - start
    order = np.argsort(-size, kind="stable")
    at, size = start[order], size[order]
    state = crc[order] ^ ONES
    n_long = int(np.searchsorted(-size, -LONG_WORD))
    for i in range(n_long):
        state[i] = zlib.crc32(data[at[i] : at[i] + size[i]], int(state[i] ^ ONES)) ^ 0xFFFFFFFF
    for k in range(int(size[n_long]) if n_long < len(size) else 0):
        m = int(np.searchsorted(-size, -k))
        own = state[n_long:m]
        state[n_long:m] = CRC[(own ^ data[at[n_long:m] + k]) & np.uint32(255)] ^ (own >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = state ^ ONES
    return out


def features(words: Words, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first word, checksum) of all runs of 1, 2, .. ``longest`` words inside a text."""
    begin = np.arange(len(words.start))
    end = np.repeat(words.first[1:], words.counts)
    crc = crc_on(np.zeros(len(begin), np.uint32), words.data, words.start, words.stop)
    yield begin, crc
    blank = np.frombuffer(b" ", np.uint8)
    for k in range(1, longest):
        on = begin + k < end
        begin, end, crc = begin[on], end[on], crc[on]
        crc = crc_on(crc, blank, np.zeros(len(begin), np.int64), np.ones(len(begin), np.int64))
        crc = crc_on(crc, words.data, words.start[begin + k], words.stop[begin + k])
        yield begin, crc


def _count(buckets: int, longest: int):
    def run(frames):
        total = np.zeros(buckets, np.int64)
        for f in batches(frames):
            for _, crc in features(Words(texts_of(f), PLAIN), longest):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """Features of all texts by bucket; summed in tasks, then by Spark, and one number a bucket comes back."""
    each = texts.mapInArrow(_count(buckets, longest), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in each.collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in the source, counts plus one."""
    b, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(y + 1) * (s + b)) / (float(x + 1) * (t + b))))
                     for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gains: np.ndarray, longest: int):
    def run(frames):
        for f in batches(frames):
            words = Words(texts_of(f), PLAIN)
            n, weight = np.zeros(f.num_rows, np.int64), np.zeros(f.num_rows, np.int64)
            for begin, crc in features(words, longest):
                edge = np.searchsorted(begin, words.first)
                sums = np.concatenate(([0], np.cumsum(gains[crc % np.uint32(len(gains))])))
                n += np.diff(edge)
                weight += np.diff(sums[edge])
            yield pa.RecordBatch.from_arrays(
                [f.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(n), pa.array(weight)],
                names=["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: str) -> Column:
    """A Gumbel variate in thousandths, from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def radix_places(rows: DataFrame, keys: list[Column], staged: Staged, digit_bits: int = DIGIT_BITS,
                 chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(row, place): places 0, 1, .. of the rows in ascending order of the composite key, rows of equal keys by ``row``.

    ``keys`` are longs, the most significant first; ``row`` a long of its own
    for each row.  Stable counting sorts go over the key's digits from the
    least significant on.  Places are dealt into chunks; a pass counts each
    chunk's digits, adds the counts up over chunks and digits to the offset of
    each, and an element's new place is its offset plus its number among the
    chunk's elements of that digit.  Digits that are equal in all rows are
    left out.  No task holds more than a chunk's elements of a digit together,
    and nothing but the digits' extremes reaches the driver.
    """
    names = [f"k{i}" for i in range(len(keys))]
    unsigned = [k.cast("long").bitwiseXOR(F.lit(-(1 << 63))).alias(n) for k, n in zip(keys, names, strict=True)]
    state = rows.select(F.col("row"), F.col("row").alias("place"), *unsigned)
    digits = [F.shiftrightunsigned(n, s).bitwiseAND(F.lit((1 << digit_bits) - 1)).cast("int")
              for n in reversed(names) for s in range(0, 64, digit_bits)]
    extremes = state.agg(*[f(d).alias(f"{g}{i}") for i, d in enumerate(digits) for f, g in ((F.min, "a"), (F.max, "b"))]).first()
    live = [d for i, d in enumerate(digits) if extremes[f"a{i}"] != extremes[f"b{i}"]] or digits[:1]  # one pass at least: it closes gaps
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    for i, d in enumerate(live):
        dealt = state.withColumns({"digit": d, "chunk": F.shiftright("place", chunk_bits)})
        counts = dealt.groupBy("digit", "chunk").agg(F.count(F.lit(1)).alias("n"))
        bases = counts.groupBy("digit").agg(F.sum("n").alias("n")).select("digit", before(Window.orderBy("digit")).alias("base"))
        offsets = counts.select("digit", "chunk", before(Window.partitionBy("digit").orderBy("chunk")).alias("shift")).join(bases, "digit")
        own = F.row_number().over(Window.partitionBy("digit", "chunk").orderBy("place"))
        moved = dealt.withColumn("own", own).join(offsets, ["digit", "chunk"])
        state = staged.put(f"pass{i}", moved.select("row", (F.col("base") + F.col("shift") + F.col("own") - 1).alias("place"), *names))
        if i:
            staged.drop(f"pass{i - 1}")
    return state.select("row", "place")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT,
             seed: str = SEED, digit_bits: int = DIGIT_BITS, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Documents weighed by how much likelier the target makes their features, and a draw without replacement.

    Returns one row per input row: doc_id, n_words, n_features, weight, score,
    rank (1, 2, .. of the drawn, NULL for others).  Features are the runs of 1
    to ``longest`` lower-cased words, hashed to ``buckets``; weight sums their
    buckets' gains and score adds Gumbel noise, so that the highest scores are
    a weighted draw.  ``percent`` of the documents of ``least_words`` words or
    more are drawn, ties by the smaller id.

    All texts are read twice, to count and to weigh; the driver holds one
    number a bucket, an array that each task gets.

    NULL and empty texts have no words, weight 0 and are never drawn (unless
    ``least_words`` is 0); NULL ids have the noise of the empty id and come
    last among equal scores; repeated rows are rows of their own, equal ones in
    stored order; an empty target gives gains from counts of one; no documents
    give no rows.  Ids are whole numbers.  Only the named columns are read.
    """
    staged = Staged(docs.sparkSession, "resample")
    rows = keeping(docs, {"doc_id": F.col(doc_id).cast("long"), "text": F.col(text)})
    wanted = keeping(target, {"text": F.col(target_text)})
    gains = bucket_gains(bucket_counts(rows.select("text"), buckets, longest), bucket_counts(wanted, buckets, longest))
    weighed = rows.mapInArrow(_weigh(gains, longest), "doc_id long, n_words long, n_features long, weight long")
    scored = staged.put("scored", weighed.select(
        F.monotonically_increasing_id().alias("row"), "*", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score")))
    able = scored.filter(F.col("n_words") >= least_words)
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    places = radix_places(able.select("row", "doc_id", "score"), [F.bitwise_not("score"), last], staged, digit_bits, chunk_bits)
    drawn = places.filter(F.col("place") < able.count() * percent // 100).select("row", (F.col("place") + 1).alias("rank"))
    return scored.join(drawn, "row", "left").drop("row")


RESAMPLE_SQL = rf"""
WITH entries AS (SELECT list(list_reduce(list_prepend(range::BIGINT, range(8)), lambda c, k:
              CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY range) AS crcs FROM range(256)),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT row, unnest(w) AS word FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
v AS (SELECT word, hex(encode(word)) AS h, octet_length(encode(word)) AS n FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
c AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))) % {BUCKETS} AS bucket FROM v, entries),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN c USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN c USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM bw) AS t),
g AS (SELECT word, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (sums.s + {BUCKETS})::DOUBLE)
        / ((coalesce(s.n, 0) + 1)::DOUBLE * (sums.t + {BUCKETS})::DOUBLE)))::BIGINT AS gain
      FROM c LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sums),
w AS (SELECT row, sum(gain)::BIGINT AS weight FROM dw JOIN g USING (word) GROUP BY row),
r AS (SELECT row, doc_id, len(w) AS n, coalesce(weight, 0) AS weight,
        ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (row)),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r),
o AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row) AS rank FROM e WHERE n >= {LEAST_WORDS})
SELECT doc_id, n::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN rank <= (SELECT count(*) * {PERCENT} // 100 FROM o) THEN rank END::BIGINT AS rank
FROM e LEFT JOIN o USING (row)"""


@query("op13_importance_resampling", RESAMPLE_SQL)
def op13_importance_resampling(spark, sf_dir):
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
