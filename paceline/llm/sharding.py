"""Sharding: jump consistent hashing sends stable keys to shards without a table of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import Staged, keeping, no_nul, query, table

# Fixed values of the published algorithm.
STEP = np.uint64(2862933555777941757)
SCALE = float(1 << 31)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key.  A key jumps to ever later shards until it would leave the last one."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    while len(going):
        key[going] = key[going] * STEP + np.uint64(1)
        nxt = ((shard[going] + 1) * (SCALE / ((key[going] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        stays = nxt < shards
        going = going[stays]
        shard[going] = nxt[stays]
    return shard.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """``jump_hash`` as a column over a long; NULL keys go where key 0 goes."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards))

    return shard(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign_shards(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text",
                  slices: int | None = None) -> DataFrame:
    """Shard and slot of every row.

    Returns one row per input row: doc_id, size (UTF-8 bytes plus 16),
    text_crc32 (unsigned), shard, slot (0, 1, .. within the shard, by doc_id),
    grown_shard (the shard with one more of them: the same one or the new one).

    Slots are numbered in slices of a sort by (shard, doc_id), whose boundaries
    Spark samples from the data; the slices' counts, at most shards + slices
    rows, shift them.  So no shard is one task's work.

    NULL text counts 16 bytes and has the checksum of the empty text; NULL ids
    go with id 0 and come first; repeated rows get a slot each; no input gives
    no rows.  Only the two named columns are read.
    """
    rows = keeping(docs, {"doc_id": F.col(doc_id), "text": F.col(text)})
    t = no_nul(F.col("text")).cast("binary")
    rows = rows.select("doc_id", (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t).alias("text_crc32"))
    rows = rows.select("*", jump_shard(F.col("doc_id"), shards).alias("shard"),
                       jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"))
    order = ["shard", "doc_id", "text_crc32", "size"]
    sliced = rows.repartitionByRange(*([slices] if slices else []), *order).withColumn("slice", F.spark_partition_id())
    stored = Staged(docs.sparkSession, "shards").put("sliced", sliced)
    sizes = stored.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
    numbered = stored.withColumn("at", F.row_number().over(own)).join(shifts, ["shard", "slice"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                           (F.col("at") - 1 + F.col("shift")).cast("long").alias("slot"), "grown_shard")


SHARDS = 40

SHARDING_SQL = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT coalesce(doc_id, 0)::BIGINT AS id FROM documents),
walk(id, n, hash, here, nxt) AS (
  SELECT id, n, CASE WHEN id < 0 THEN id::HUGEINT + 18446744073709551616 ELSE id::HUGEINT END, -1::BIGINT, 0::BIGINT
  FROM ids, (VALUES ({SHARDS}), ({SHARDS + 1})) AS v(n)
  UNION ALL
  SELECT id, n, k, nxt, floor((nxt + 1) * (2147483648.0::DOUBLE / ((k >> 33)::DOUBLE + 1)))::BIGINT
  FROM (SELECT id, n, nxt, (hash * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM walk WHERE nxt < n)),
jumps AS (SELECT id, max(here) FILTER (n = {SHARDS}) AS shard, max(here) FILTER (n = {SHARDS + 1}) AS grown FROM walk GROUP BY id),
entries AS (SELECT list(list_reduce(list_prepend(range::BIGINT, range(8)), lambda c, k:
              CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY range) AS crcs FROM range(256)),
texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
sums AS (SELECT doc_id, n + 16 AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM texts, entries)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot,
       grown::INTEGER AS grown_shard
FROM sums JOIN jumps ON coalesce(doc_id, 0) = id"""


@query("op8_jump_shards", SHARDING_SQL)
def op8_jump_shards(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"), SHARDS)
