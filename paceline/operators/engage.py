"""Interest, referrals and reports: keyed appends, deletes, joins, growth metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline import fixed_values as V

GAP = f"INTERVAL {V.REPORT_GAP_SECONDS} SECONDS"


def _known(df: DataFrame) -> DataFrame:
    return df.filter(F.col("user_id").isNotNull())


def _anonymous(df: DataFrame) -> DataFrame:
    return df.filter(F.col("user_id").isNull())


def unique_interest(rows: DataFrame) -> DataFrame:
    """Earliest row per (user, race); anonymous rows are all kept.

    ``min_by`` combines before the shuffle, so a hot pair never gathers in one task.
    """
    first = _known(rows).groupBy("user_id", "race_id").agg(F.min_by(F.struct(*rows.columns), F.struct("created_at", "id")).alias("r"))
    return first.select("r.*").unionByName(_anonymous(rows))


def append_interest(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch to append: no known user twice per race."""
    once = unique_interest(batch)
    fresh = _known(once).join(_known(existing).select("user_id", "race_id").distinct(), ["user_id", "race_id"], "left_anti")
    return fresh.select(*batch.columns).unionByName(_anonymous(once))


def remove_interest(existing: DataFrame, deletes: DataFrame) -> DataFrame:
    """Interest without the (user, race) pairs to delete; anonymous rows stay."""
    keys = deletes.select("user_id", "race_id").distinct()
    kept = _known(existing).join(keys, ["user_id", "race_id"], "left_anti")
    return kept.select(*existing.columns).unionByName(_anonymous(existing))


def has_interest(asked: DataFrame, interest: DataFrame) -> DataFrame:
    """Asked (user, race) pairs that exist."""
    return asked.join(_known(interest).select("user_id", "race_id").distinct(), ["user_id", "race_id"], "left_semi")


def referral_rows(interest: DataFrame) -> DataFrame:
    """Edges to append: who referred whom to which race."""
    return interest.filter(F.col("referred_by").isNotNull() & F.col("user_id").isNotNull()).select(
        "id", F.col("referred_by").alias("referrer_id"), F.col("user_id").alias("referred_id"), "race_id", "created_at")


def append_referrals(existing: DataFrame, interest: DataFrame) -> DataFrame:
    return existing.unionByName(referral_rows(interest))


def user_races(interest: DataFrame, races: DataFrame, user: Column | None = None) -> DataFrame:
    """Interests with their race, rows of vanished races left out."""
    rows = _known(interest) if user is None else interest.filter(F.col("user_id") == user)
    return rows.join(races, "race_id")


def interest_counts(interest: DataFrame) -> DataFrame:
    return interest.groupBy("race_id").agg(F.count(F.lit(1)).alias("n"))


def cascade(child: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children left after their parents are deleted."""
    return child.join(deleted.select(key), key, "left_anti")


def set_null(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Children whose missing parent is cleared instead."""
    known = parent.select(F.col(key).alias("_k")).distinct().withColumn("_ok", F.lit(True))
    joined = child.join(known, F.col(key) == F.col("_k"), "left")
    return joined.withColumn(key, F.when(F.col("_ok"), F.col(key))).drop("_k", "_ok")


def anti_recent(batch: DataFrame, history: DataFrame, key: str = "race_id") -> DataFrame:
    """Reports with none in history for the same key within the last minute.

    History shrinks to its first and last time per key and minute slot, before
    the shuffle.  A report is blocked by its own slot if the slot's first time
    is not later, and by the slot before if that one's last time is less than a
    minute old; so each report meets at most two rows, however busy the key.
    """
    slot = F.floor(F.unix_micros("created_at") / (V.REPORT_GAP_SECONDS * 1_000_000))
    slots = history.groupBy(F.col(key).alias("k"), slot.alias("m")).agg(
        F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    marked = batch.withColumn("_m", slot)
    own, at = F.col(key) == F.col("k"), F.col("created_at")
    clear = marked.join(slots, own & (F.col("_m") == F.col("m")) & (F.col("first") <= at), "left_anti")
    before = slots.withColumn("m", F.col("m") + 1)
    clear = clear.join(before, own & (F.col("_m") == F.col("m")) & (F.col("last") > at - F.expr(GAP)), "left_anti")
    return clear.drop("_m")


# --- Growth metrics ----------------------------------------------------------

FUNNEL = ("view", "signup", "click", "purchase")


#: Seconds of a slot in which a user's events are read in one piece.
SLOT_SECONDS = 600


def funnel_rates(events: DataFrame, steps: tuple[str, ...] = FUNNEL, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Users reaching each step after the one before, and the step's rate.

    A step counts at its first time not before the previous step was reached.
    A user's events of one slot of time make a table: who enters the slot with
    so many steps done leaves it with so many.  Tables are then applied in the
    order of slots.  Events are read once, and a user of very many events is
    many groups; what meets per user is one short table a slot.  Rows without
    user or time don't count.
    """
    step = F.array_position(F.array(*[F.lit(n) for n in steps]), F.col("event_type")).cast("int") - 1
    own = events.filter("user_id IS NOT NULL AND ts IS NOT NULL").select(
        "user_id", "ts", step.alias("step"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (slot_seconds * 1_000_000)).alias("slot")).filter("step >= 0")
    done = F.array(*[F.lit(i) for i in range(len(steps) + 1)])
    table = F.aggregate(F.sort_array(F.collect_list(F.struct("ts", "step"))), done, lambda at, e: F.transform(
        at, lambda n: F.when(n == e["step"], n + 1).otherwise(n)))
    tables = own.groupBy("user_id", "slot").agg(table.alias("leaves"))
    reached = F.aggregate(F.sort_array(F.collect_list(F.struct("slot", "leaves"))), F.lit(0), lambda n, t: F.get(t["leaves"], n))
    users = tables.groupBy("user_id").agg(reached.alias("n")).filter("n > 0").select(
        F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias("users"))
    named = events.sparkSession.range(len(steps)).select(
        F.col("id").cast("int").alias("step"), F.get(F.array(*[F.lit(n) for n in steps]), F.col("id").cast("int")).alias("name"))
    out = named.join(users, "step", "left").select("step", "name", F.coalesce("users", F.lit(0)).alias("users"))
    before = F.lag("users").over(Window.orderBy("step"))  # one row per step
    return out.withColumn("rate", F.round(F.col("users") / F.nullif(before, F.lit(0)), 6))


def referred_share(interest: DataFrame) -> DataFrame:
    """Sign-ups in all, from referrals, and the share."""
    rows = _known(interest)
    return rows.agg(
        F.count(F.lit(1)).alias("signups"), F.count("referred_by").alias("referred"),
        F.round(F.count("referred_by") / F.count(F.lit(1)), 6).alias("share"))


def viral_coefficient(interest: DataFrame, referrals: DataFrame) -> DataFrame:
    """Per week: referrals made for each registered user of that week."""
    week = F.date_trunc("week", F.col("created_at")).cast("date")
    users = _known(interest).select(week.alias("week"), "user_id").distinct().groupBy("week").agg(F.count(F.lit(1)).alias("users"))
    made = referrals.groupBy(week.alias("week")).agg(F.count(F.lit(1)).alias("referrals"))
    return users.join(made, "week", "left").select(
        "week", "users", F.coalesce("referrals", F.lit(0)).alias("referrals"),
        F.round(F.coalesce("referrals", F.lit(0)) / F.col("users"), 6).alias("k"))


def referrer_leaderboard(referrals: DataFrame) -> DataFrame:
    """Referrals per referrer with dense rank.

    Ranks are computed over the distinct counts, of which there are few, and
    joined back: no window over all referrers.
    """
    n = referrals.groupBy("referrer_id").agg(F.count(F.lit(1)).alias("n"))
    ranks = n.select("n").distinct().withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("n"))))
    return n.join(ranks, "n").select("referrer_id", "n", F.col("rank").cast("bigint").alias("rank"))


def referred_retention(referrals: DataFrame, events: DataFrame) -> DataFrame:
    """Per first week of referred users: users seen again k weeks later."""
    def week(col):
        return F.date_trunc("week", F.col(col)).cast("date")

    cohort = referrals.groupBy(F.col("referred_id").alias("user_id")).agg(F.min(week("created_at")).alias("cohort"))
    active = events.select("user_id", week("ts").alias("week")).distinct()
    seen = cohort.join(active, "user_id").filter(F.col("week") >= F.col("cohort"))
    return seen.groupBy("cohort", (F.datediff("week", "cohort") / 7).cast("int").alias("weeks_later")).agg(F.count(F.lit(1)).alias("users"))
