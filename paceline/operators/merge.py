"""Survivorship: one race per group, field by field.

Aggregation runs in two steps.  Step one combines rows per exact group key
(with map-side partial aggregation, so a key holding a third of all rows is
reduced before it is shuffled); step two combines the few groups that near
duplicate matching joined.  Row order within a group is (first order of the
exact group, order), which both steps respect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline import fixed_values as V
from paceline.functions import labels as L
from paceline.functions import parse as P
from paceline.functions.text import is_blank, null_if_empty
from paceline.operators.ordering import numbered_within, spread_null_key
from paceline.operators.resolve import exact_groups, group_ids, with_group_key
from paceline.session import stage


# --- Reducers: Column aggregates over an order column ------------------------

def pick_longest(value: Column, order: Column) -> Column:
    """Longest non-blank text, first on ties."""
    size = F.when(~is_blank(value), F.struct(F.length(value), -order))
    return F.max_by(value, size)


def pick_shortest(value: Column, order: Column) -> Column:
    """Shortest non-blank text, first on ties."""
    size = F.when(~is_blank(value), F.struct(F.length(value), order))
    return F.min_by(value, size)


def pick_first(value: Column, order: Column) -> Column:
    """First value that is not NULL."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def terrain_rank(terrain: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in V.TERRAIN_ORDER]), terrain).cast("int")


def terrain_of_rank(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in V.TERRAIN_ORDER]), rank - 1)


# --- Distances ---------------------------------------------------------------

def merge_distances(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Distances per key from rows ``(keys, km, pos, label, label_pos)``.

    In order of ``pos`` an entry joins the first kept distance closer than the
    tolerance, else it is kept; the longest label wins, first on ties; longest
    distance first.  Equal km of one key always end up together, so they are
    combined first; then the km line is cut at gaps of at least the tolerance,
    since no entry can reach across one.  What one fold sees is a run of
    distinct km values, not the rows behind them.
    """
    better = F.struct((-F.length("label")).alias("size"), F.col("label_pos").alias("label_pos"), F.col("label").alias("label"))
    distinct = (  # all steps below work within a key: one shuffle serves them
        entries.repartition(*keys).groupBy(*keys, "km").agg(F.min("pos").alias("pos"), F.min(better).alias("best"))
        .select(*keys, "km", "pos", F.col("best.label").alias("label"), F.col("best.label_pos").alias("label_pos"))
    )
    along = Window.partitionBy(*keys).orderBy("km")
    starts = F.coalesce(F.col("km") - F.lag("km").over(along) >= V.GROUP_TOLERANCE_KM, F.lit(True))
    runs = distinct.withColumn("starts", starts.cast("int")).withColumn(
        "run", F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, 0))
    )
    entry = F.struct("pos", "km", "label", "label_pos")
    listed = runs.groupBy(*keys, "run").agg(F.sort_array(F.collect_list(entry)).alias("seq"))
    empty = F.array().cast(
        "array<struct<km:double,label:string,label_pos:struct<first_ord:bigint,ord:bigint,idx:int>>>"
    )

    def beats(kept, new):
        size, held = F.length(new["label"]), F.length(kept["label"])
        return (size > held) | ((size == held) & (new["label_pos"] < kept["label_pos"]))

    def fold(acc, d):
        new = F.struct(d["km"].alias("km"), d["label"].alias("label"), d["label_pos"].alias("label_pos"))
        near = F.transform(acc, lambda k: F.abs(k["km"] - d["km"]) < V.GROUP_TOLERANCE_KM)
        at = F.array_position(near, F.lit(True))
        joined = F.transform(acc, lambda k, i: F.when((i + 1 == at) & beats(k, new), F.struct(
            k["km"].alias("km"), new["label"].alias("label"), new["label_pos"].alias("label_pos"))).otherwise(k))
        return F.when(at > 0, joined).otherwise(F.concat(acc, F.array(new)))

    kept = F.aggregate("seq", empty, fold)
    return (
        listed.select(*keys, kept.alias("kept"))
        .groupBy(*keys).agg(F.flatten(F.collect_list("kept")).alias("kept"))
        .select(*keys, P.sort_distances(F.transform("kept", lambda d: F.struct(
            d["label"].alias("label"), d["km"].alias("km")))).alias("distances"))
    )


# --- Groups ------------------------------------------------------------------

def summarize(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Step one: every surviving scalar per exact key."""
    ord_ = F.col("ord")
    organizer = P.extract_organizer(F.col("contact"))
    return keyed.groupBy(*keys).agg(
        F.min("ord").alias("first_ord"),
        F.count(F.lit(1)).alias("n_rows"),
        pick_longest(F.col("title"), ord_).alias("name"),
        pick_longest(F.col("description"), ord_).alias("description"),
        pick_first(F.col("startTime"), ord_).alias("time_start"),
        pick_shortest(F.col("city"), ord_).alias("city"),
        pick_first(null_if_empty(F.col("region")), ord_).alias("region"),
        F.max(terrain_rank(F.col("terrain"))).alias("terrain_rank"),
        F.min("priceFrom").alias("price_from"),
        F.max("priceTo").alias("price_to"),
        pick_first(F.col("website"), ord_).alias("website"),
        F.min_by(F.struct(organizer.alias("name")), F.when(F.col("source") == V.ORGANIZER_FIRST_SOURCE, ord_)).alias("preferred"),
        pick_first(organizer, ord_).alias("any_organizer"),
        F.collect_set("source").alias("sources"),
    )


def combine(summaries: DataFrame, keys: list[str], *same: Column) -> DataFrame:
    """Step two: summaries of several exact groups into one; ``same``: further aggregates, of what all have in common."""
    ord_ = F.col("first_ord")
    return summaries.groupBy(*keys).agg(
        *same,
        F.min("first_ord").alias("first_ord"),
        F.sum("n_rows").alias("n_rows"),
        pick_longest(F.col("name"), ord_).alias("name"),
        pick_longest(F.col("description"), ord_).alias("description"),
        pick_first(F.col("time_start"), ord_).alias("time_start"),
        pick_shortest(F.col("city"), ord_).alias("city"),
        pick_first(F.col("region"), ord_).alias("region"),
        F.max("terrain_rank").alias("terrain_rank"),
        F.min("price_from").alias("price_from"),
        F.max("price_to").alias("price_to"),
        pick_first(F.col("website"), ord_).alias("website"),
        F.min_by("preferred", F.when(F.col("preferred").isNotNull(), ord_)).alias("preferred"),
        pick_first(F.col("any_organizer"), ord_).alias("any_organizer"),
        F.array_distinct(F.flatten(F.collect_set("sources"))).alias("sources"),
    )


def resolve_items(items: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """Keyed rows, and ``(group_key, phase, date, first_ord, n_rows, group_id)``."""
    keyed = stage(with_group_key(items), "listings")
    return keyed, stage(group_ids(stage(exact_groups(keyed), "groups"), **limits), "ids")


def merge_scalars(keyed: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per group: all fields but the distances."""
    summaries = summarize(keyed, ["group_key"])
    led = summaries.join(ids.select("group_key", "phase", "date", "group_id"), "group_key")
    return combine(led, ["group_id"], F.min("phase").alias("phase"), F.min("date").alias("date"))


def distance_entries(keyed: DataFrame, ids: DataFrame) -> DataFrame:
    """Distances of all rows with their group and position; repeats of a key combined early."""
    exploded = keyed.select("group_key", "ord", F.posexplode("distances").alias("idx", "d"))
    slim = exploded.select(
        "group_key", F.col("d.km").alias("km"), F.col("d.label").alias("label"),
        F.struct(F.col("ord"), F.col("idx")).alias("at"),
    )
    early = slim.groupBy("group_key", "km").agg(
        F.min("at").alias("at"),
        F.min(F.struct((-F.length("label")).alias("size"), F.col("at").alias("at"), F.col("label").alias("label"))).alias("best"),
    )
    at_ids = early.join(ids.select("group_key", "first_ord", "group_id"), "group_key")

    def pos(at):
        return F.struct(F.col("first_ord"), F.col(f"{at}.ord").alias("ord"), F.col(f"{at}.idx").alias("idx"))

    return at_ids.select("group_id", "km", pos("at").alias("pos"), pos("best.at").alias("label_pos"), F.col("best.label").alias("label"))


def merge_groups(keyed: DataFrame, ids: DataFrame) -> DataFrame:
    """One merged race per group, still without slug."""
    scalars = merge_scalars(keyed, ids)
    distances = merge_distances(distance_entries(keyed, ids), ["group_id"])
    none = F.array().cast(P.DISTANCES)
    return scalars.join(distances, "group_id", "left").select(
        "group_id", "phase", "n_rows",
        F.coalesce("name", F.lit("")).alias("name"),
        "description",
        F.col("date").alias("date_start"),
        "time_start",
        F.coalesce("city", F.lit("")).alias("city"),
        "region",
        F.lit("CZ").alias("country"),
        F.coalesce("distances", none).alias("distances"),
        terrain_of_rank(F.col("terrain_rank")).alias("terrain"),
        "price_from", "price_to",
        F.lit("CZK").alias("currency"),
        "website",
        P.normalize_website(F.col("website")).alias("official_url"),
        F.lit("extracted").alias("extraction_status"),
        F.array_join(F.sort_array("sources"), ",").alias("source"),
        F.lit("confirmed").alias("status"),
        F.coalesce("preferred.name", "any_organizer").alias("organizer"),
    )


def null_shared_urls(races: DataFrame, counted: DataFrame | None = None, row_id: str = "group_id") -> DataFrame:
    """Clear ``official_url`` where several races carry the same one.

    Counts, pre-aggregated, come from ``counted`` (the same races, stored) if
    given; the join splits NULLs over all partitions.
    """
    shared = (
        (counted or races).filter(F.col("official_url").isNotNull()).groupBy("official_url").count()
        .filter("count > 1").select(F.col("official_url").alias("_key"), F.lit(True).alias("_shared"))
    )
    keyed = races.withColumn("_key", spread_null_key(F.col("official_url"), F.col(row_id)))
    joined = keyed.join(shared, "_key", "left")
    return joined.withColumn("official_url", F.when(F.col("_shared").isNull(), F.col("official_url"))).drop("_key", "_shared")


def assign_slugs(races: DataFrame) -> DataFrame:
    """Unique slug per race: the n-th repeat of a base slug, in group order, gets ``-n``."""
    based = races.withColumn("_base", L.slug_base(F.col("name"), F.col("date_start")))
    ranked = numbered_within(based, ["_base"], "group_id", "_nth", lead=["phase"])
    slug = F.when(F.col("_nth") > 1, F.concat("_base", F.lit("-"), F.col("_nth").cast("string"))).otherwise(F.col("_base"))
    return ranked.withColumn("slug", slug).drop("_base", "_nth")


def finish(merged: DataFrame) -> DataFrame:
    """Slugs assigned and shared addresses cleared; the merged races are stored once before."""
    stored = stage(merged, "merged")
    return null_shared_urls(assign_slugs(stored), stored)
