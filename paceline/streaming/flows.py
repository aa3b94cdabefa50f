"""Structured Streaming forms of ingest, throttling, counting and unique interest.

Sources and checkpoints are folders; every flow can stop and resume from its
checkpoint.  ``drain`` runs a flow over what is there now, in as many
micro-batches as the trigger options ask for.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from paceline import fixed_values as V
from paceline.functions.text import is_blank
from paceline.operators import normalize as N
from paceline.operators.upsert import upsert_races
from paceline.plans.integrate import integrate
from paceline.session import scratch_path, stage
from paceline.sources.listings import CORRUPT, RAW_SCHEMA, dataset_glob, require_fields, with_order, with_provenance


def folder_stream(spark: SparkSession, schema, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Append the stream to Parquet until the source is exhausted; the result as a batch."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drain_batches(stream: DataFrame, handle, checkpoint: str, mode: str = "append") -> None:
    query = (
        stream.writeStream.foreachBatch(handle).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


# --- Ingest ------------------------------------------------------------------

def listing_stream(spark: SparkSession, root: str, multi_line: bool = True, **options) -> DataFrame:
    """New JSON files under the dataset folders, complete rows only; ``ingest_flow`` keeps the others too."""
    raw = folder_stream(spark, RAW_SCHEMA, dataset_glob(root), "json", multiLine=multi_line, pathGlobFilter="*.json", **options)
    return require_fields(with_provenance(raw))


def ingest_stream(spark: SparkSession, root: str, **options) -> DataFrame:
    """Normalised accepted rows of new files; ``ord`` is left to the batch that resolves them."""
    raw = listing_stream(spark, root, **options).withColumn("ord", F.lit(None).cast("bigint"))
    return N.accepted(N.normalize_items(raw)).drop("ord")


def raw_stream(spark: SparkSession, root: str, multi_line: bool = True, names: str = "*.json", **options) -> DataFrame:
    """New files under the dataset folders, unreadable rows kept in the corrupt column."""
    schema = StructType([*RAW_SCHEMA.fields, StructField(CORRUPT, StringType())])
    return with_provenance(folder_stream(
        spark, schema, dataset_glob(root), "json", multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT,
        pathGlobFilter=names, **options))


def ingest_flow(out: str, quarantine: str):
    """Micro-batch handler: accepted rows to ``out``, all others with their reason to ``quarantine``.

    Every row of the input is in one of the two.  A repeated micro-batch writes
    its own folders again.
    """
    def handle(batch: DataFrame, number: int) -> None:
        lacks = is_blank(F.col("title")) | is_blank(F.col("date"))
        judged = batch.withColumn("reason", F.when(F.col(CORRUPT).isNotNull(), "unreadable").when(lacks, "incomplete"))
        items = N.normalize_items(judged.filter("reason IS NULL").withColumn("ord", F.lit(None).cast("bigint")))
        N.accepted(items).drop("ord").write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))
        early = judged.filter("reason IS NOT NULL").select("source", "url", "title", "reason", F.col(CORRUPT).alias("raw"))
        late = N.rejected(items).select("source", F.col("sourceUrl").alias("url"), "title", F.col("reject_reason").alias("reason"),
                                        F.lit(None).cast("string").alias("raw"))
        early.unionByName(late).write.mode("overwrite").parquet(os.path.join(quarantine, f"batch={number}"))

    return handle


class RaceTable:
    """Race table in buckets of its slug, with an index from addresses to slugs in buckets of the address.

    A micro-batch reads the buckets that its rows' addresses and slugs lead to,
    and writes new versions of those that change; a version's list says which
    folder holds each bucket now.  A micro-batch always starts from the version
    before its own, so a repeated one writes the same again, and until its list
    is there nothing of it is seen: a lost executor or a restart does no harm.
    ``create`` gives a table its first rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema, buckets: int = 64):
        empty = spark.createDataFrame([], schema)
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schema = empty.schema
        self.pairs = StructType([StructField(c, StringType()) for c in ("official_url", "slug")])

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _list(self, number: int) -> dict[tuple[str, int], int]:
        """Version of each bucket that has rows, as of a version; nothing before the first one."""
        path = os.path.join(self.path, "lists", f"v{number}")
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if number < 0 and not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return {}
        return {(r.kind, r.bucket): r.version for r in self.spark.read.schema(LIST).parquet(path).collect()}

    def _open(self, kind: str, listed: dict, buckets: set[int] | None = None) -> DataFrame:
        schema = self.schema if kind == "slug" else self.pairs
        paths = [os.path.join(self.path, kind, f"v{v}", f"bucket={b}") for (k, b), v in sorted(listed.items())
                 if k == kind and (buckets is None or b in buckets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, kind: str, key: str, rows: DataFrame, number: int) -> set[int]:
        """Write rows by bucket; the buckets that have some."""
        rows = rows.withColumn("bucket", self._bucket(key))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(os.path.join(self.path, kind, f"v{number}"))
        return _numbers(rows.select("bucket"))

    def _publish(self, listed: dict, number: int) -> None:
        rows = self.spark.createDataFrame([(k, b, v) for (k, b), v in sorted(listed.items())], LIST)
        rows.coalesce(1).write.mode("overwrite").parquet(os.path.join(self.path, "lists", f"v{number}"))

    def create(self, races: DataFrame) -> None:
        races = stage(races.select(*self.schema.names), "races")
        listed = {("slug", b): -1 for b in self._write("slug", "slug", races, -1)}
        listed |= {("url", b): -1 for b in self._write("url", "official_url", races.filter("official_url IS NOT NULL").select(*self.pairs.names), -1)}
        self._publish(listed, -1)

    def read(self, number: int) -> DataFrame:
        return self._open("slug", self._list(number))

    def upsert(self, races: DataFrame, number: int, as_of: str) -> None:
        """Write the next version; rows that can't be written go to ``rejected/batch=<number>`` with their reason."""
        listed, batch = self._list(number - 1), stage(races, "batch")
        urls = batch.filter("official_url IS NOT NULL").select("official_url")
        index = self._open("url", listed, _numbers(urls.select(self._bucket("official_url"))))
        known = index.join(urls.distinct(), "official_url", "left_semi").select("slug")
        touched = _numbers(batch.select("slug").unionByName(known).select(self._bucket("slug")))
        before = self._open("slug", listed, touched)
        after, rejected = upsert_races(before, batch, as_of)
        after = stage(after, "after")
        rejected.write.mode("overwrite").parquet(os.path.join(self.path, "rejected", f"batch={number}"))
        now = {("slug", b): number for b in self._write("slug", "slug", after, number)}

        pairs = lambda rows: rows.filter("official_url IS NOT NULL").select(*self.pairs.names)
        gone, new = pairs(before).subtract(pairs(after)), pairs(after).subtract(pairs(before))
        moved = stage(gone.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True))), "moved")
        redone = _numbers(moved.select(self._bucket("official_url")))
        index = self._open("url", listed, redone).join(moved.filter("NOT new"), self.pairs.names, "left_anti")
        index = index.unionByName(moved.filter("new").drop("new"))
        now |= {("url", b): number for b in self._write("url", "official_url", index, number)}
        kept = {k: v for k, v in listed.items() if not (k[0] == "slug" and k[1] in touched or k[0] == "url" and k[1] in redone)}
        self._publish(kept | now, number)


LIST = "kind string, bucket int, version int"


def _numbers(rows: DataFrame) -> set[int]:
    """Distinct bucket numbers: as many as there are buckets at most."""
    return {r[0] for r in rows.distinct().collect()}


def upsert_flow(table: RaceTable, as_of: str):
    """Micro-batch handler: integrate the new listings and upsert the races."""
    def handle(batch: DataFrame, number: int) -> None:
        races = integrate(with_order(batch))
        table.upsert(races.withColumn("date_start", F.col("date_start").try_cast("date")), number, as_of)

    return handle


# --- Throttle ----------------------------------------------------------------

def _accept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows at least a minute after the key's last accepted one, in time order.

    The state goes when the watermark has passed that minute: no row that still
    counts can then fall into it.
    """
    if state.hasTimedOut:
        state.remove()
        return
    gap = V.REPORT_GAP_SECONDS * 1_000_000
    rows = pd.concat([b for b in batches if len(b)]).sort_values(["created_at", "id"])
    micros = rows["created_at"].astype("datetime64[us]").astype("int64").to_numpy()
    last = state.get[0] if state.exists else None
    keep = []
    for i, at in enumerate(micros):
        if last is None or at - last >= gap:
            keep.append(i)
            last = int(at)
    if last is not None:
        state.update((last,))
        state.setTimeoutTimestamp(max((last + gap) // 1000, state.getCurrentWatermarkMs() + 1))
    chosen = rows.iloc[keep]
    if len(chosen):
        yield chosen.assign(key=key[0])[["key", "id", "created_at"]]


def throttle_stream(reports: DataFrame, key: str = "race_id", watermark: str = "10 minutes") -> DataFrame:
    """At most one accepted report per key and minute; rejected ones do not extend the block.

    The key may be of any type.  State is one time per key, kept until the
    watermark passes the minute it blocks.  What a key brings in one micro-batch is bounded
    by the source's ``maxFilesPerTrigger``; for a backlog use the batch form in
    ``operators.throttle``.
    """
    slim = reports.select(F.col(key).alias("key"), "id", "created_at").withWatermark("created_at", watermark)
    out = f"key {reports.schema[key].dataType.simpleString()}, id long, created_at timestamp"
    return slim.groupBy("key").applyInPandasWithState(_accept, out, "last long", "append", GroupStateTimeout.EventTimeTimeout)


# --- Interest ----------------------------------------------------------------

def interest_counts_stream(interest: DataFrame, width: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Interest per race and time window."""
    return interest.withWatermark("created_at", watermark).groupBy(
        F.window("created_at", width).alias("w"), "race_id"
    ).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "race_id", "n")


def latest_counts(stream: DataFrame, spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """Run a counting flow in update mode; each batch's changes are kept, the last one counts."""
    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(path, f"batch={number}"))

    drain_batches(stream, handle, checkpoint, "update")
    changes = spark.read.parquet(path)
    return changes.groupBy("start", "race_id").agg(F.max_by("n", "batch").alias("n"))


def keep_state_by_key(spark: SparkSession) -> None:
    """State of this session's streams in a store that looks keys up, so that a batch touches only its own keys."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def unique_interest_stream(interest: DataFrame, watermark: str | None = "1 hour") -> DataFrame:
    """Drops repeats of (user, race) seen within the watermark, or, without one, however old; anonymous rows pass.

    State is one key a pair.  Without a watermark it is kept for good, as a
    unique key would be: use ``keep_state_by_key``, so that a batch reads its
    own pairs and not the history.  Which of a pair's rows of one micro-batch
    stays is left open.
    """
    known, others = interest.filter(F.col("user_id").isNotNull()), interest.filter(F.col("user_id").isNull())
    if watermark is None:
        return known.dropDuplicates(["user_id", "race_id"]).unionByName(others)
    known = known.withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(["user_id", "race_id"])
    return known.unionByName(others.withWatermark("created_at", watermark))


def stream_paths(spark: SparkSession, label: str) -> tuple[str, str]:
    root = scratch_path(spark, label)
    return os.path.join(root, "out"), os.path.join(root, "checkpoint")
