"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.session import stage


def component_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, comp)`` for every node of the edges; ``comp`` is the smallest node it reaches.

    Every round ties each node to the smallest node in its neighbourhood and
    its neighbours to that one, in two grouped steps, so that paths halve: the
    rounds grow with the logarithm of the longest path, the edges never grow,
    and no component is gathered in one task.  The driver reads one sum a round.
    """
    links = edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).filter("high > low").distinct()
    seen, links = None, stage(links, "links")
    while True:
        both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy("high").agg(F.min("low").alias("least")).select("high", F.least("high", "least").alias("least"))
        larger = both.filter("low > high").join(least, "high").select(F.col("low").alias("high"), F.col("least").alias("low"))
        larger = larger.filter("high > low").distinct()
        floor = larger.groupBy("high").agg(F.min("low").alias("least"))
        tied = larger.join(floor, "high").select(F.explode(F.array(
            F.struct(F.col("low").alias("high"), F.col("least").alias("low")),
            F.struct(F.col("high").alias("high"), F.col("least").alias("low")))).alias("e")).select("e.*")
        links = stage(tied.filter("high > low").distinct(), "links")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("low").alias("node")).distinct()
    return links.select(F.col("high").alias("node"), F.col("low").alias("comp")).unionByName(
        roots.select("node", F.col("node").alias("comp")))
