"""Row numbers within keys that stay parallel when one key is very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64


def numbered_within(
    df: DataFrame, keys: list[str], order: str, name: str, lead: list[str] | None = None, slices: int = SLICES
) -> DataFrame:
    """``row_number()`` over ``keys`` by ``lead + [order]``.

    Rows are cut into slices of the order column (approximate quantiles, read
    once as a scalar subquery), numbered inside ``(keys, slice)`` and shifted by
    the sizes of the key's earlier slices.  A key holding a third of all rows is
    thus sorted by many tasks instead of one.  Only keys that reach over a slice
    border need a shift, so that join side is small.  ``df`` is read three
    times: give it a stored table.
    """
    lead = lead or []
    points = [i / slices for i in range(1, slices)]
    cuts = df.select(F.percentile_approx(order, points, 1000)).scalar()
    sliced = df.withColumn("_cuts", cuts).withColumn(
        "_slice", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order))), F.lit(0))
    ).drop("_cuts")
    part = [*keys, *lead, "_slice"]
    sizes = sliced.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*lead, "_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*part, F.sum("_n").over(before).alias("_shift")).filter(F.col("_shift") > 0)
    local = Window.partitionBy(*part).orderBy(order)
    numbered = sliced.withColumn("_rank", F.row_number().over(local)).join(shifts, part, "left")
    rank = F.col("_rank") + F.coalesce("_shift", F.lit(0))
    return numbered.withColumn(name, rank.cast("bigint")).drop("_slice", "_rank", "_shift")


def spread_null_key(key: Column, row_id: Column) -> Column:
    """Join key that sends NULL keys to many partitions; they match nothing either way."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), row_id.cast("string")))
