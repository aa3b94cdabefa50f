"""Connected components of an edge table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import Staged


def connected(edges: DataFrame, staged: Staged, label: str) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Alternates the two star steps: first every larger neighbour of a node is
    tied to the node's smallest neighbour, then every smaller one.  The number
    of rounds grows with the logarithm of the largest component, edges never
    grow, and no component is gathered in one place.  The only thing the driver
    reads is one sum per round.
    """
    e = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, last, n = staged.put(f"{label}0", e), None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        small = small.filter("u != v").distinct()
        n += 1
        new = staged.put(f"{label}{n}", small)
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        staged.drop(f"{label}{n - 1}")
        if tuple(state) == last:
            break
        e, last = new, tuple(state)
    roots = new.select(F.col("v").alias("node")).distinct()
    return new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root")))
