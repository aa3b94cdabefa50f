"""Entity resolution: exact groups, then near-duplicate groups of one date.

Exact groups need no shuffle of their own: rows carry a group key.  Near
duplicates follow a greedy rule -- groups in order, each unabsorbed group is a
leader and absorbs every later match -- which is the lexicographically first
maximal independent set of the match graph.  It is computed in parallel and
exactly.  Dates are independent: one of few groups is a task's work
(``lead_date``); a larger one is solved over its match graph, cut into
connected components that are dealt over tasks (``leader_links``).
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from paceline import fixed_values as V
from paceline.functions import text as T
from paceline.functions.parse import url_dedup_key
from paceline.operators.components import component_labels
from paceline.session import stage

#: Composite groups of a date, and match edges, that are one task's work; candidate comparisons of a date at once.
#: They choose the path only; results are the same.
LOCAL_NODES = 5_000
LOCAL_EDGES = 200_000
PAIR_BUDGET = 50_000_000
HOT_TOKENS = 1000


def with_group_key(items: DataFrame) -> DataFrame:
    """Add ``phase`` and ``group_key``: web address and date, else name, date and city.

    A row with an address never shares a key with a row without one.
    """
    url = url_dedup_key(F.col("website"))
    by_url = F.coalesce(url != "", F.lit(False))
    return items.select(
        "*",
        F.when(by_url, 1).otherwise(2).alias("phase"),
        F.when(by_url, F.concat_ws("|", F.lit("u"), url, "date"))
        .otherwise(
            F.concat_ws("|", F.lit("c"), T.normalize_text(F.col("title")), "date", T.normalize_text(F.col("city")))
        )
        .alias("group_key"),
    )


def exact_groups(keyed: DataFrame) -> DataFrame:
    """One row per exact group; ``first_ord`` identifies and orders it."""
    return keyed.groupBy("group_key", "phase", "date").agg(
        F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n_rows")
    )


def _signature(groups: DataFrame) -> DataFrame:
    """Token sets of the composite groups, read back from their key."""
    parts = F.split("group_key", r"\|")
    names = F.sort_array(T.token_set(F.get(parts, F.lit(1))))
    cities = F.sort_array(T.token_set(F.get(parts, F.lit(3))))
    return groups.select(
        "*",
        F.when(F.size(names) == 0, F.array(F.lit(""))).otherwise(names).alias("names"),
        cities.alias("cities"),
    )


def _with_prefix(nodes: DataFrame, threshold: float) -> DataFrame:
    """Add the rarest-first prefix of the name tokens.

    Two sets with Jaccard >= t share a token among the first
    ``n - ceil(t*n) + 1`` of each, whatever common order is used; putting the
    most frequent tokens last keeps the join keys selective.  The list of
    frequent tokens has a fixed maximum length and only steers speed.
    """
    hot = (
        nodes.select(F.explode("names").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "t").limit(HOT_TOKENS)
        .select(F.map_from_entries(F.collect_list(F.struct("t", "n")))).scalar()
    )
    rarest = F.sort_array(
        F.transform("names", lambda w: F.struct(
            F.coalesce(F.try_element_at(F.col("_hot"), w), F.lit(0)).alias("n"), w.alias("t")))
    )
    need = F.ceil(F.size("names") * threshold - 1e-9)
    return nodes.withColumn("_hot", hot).withColumn(
        "prefix", F.transform(F.slice(rarest, F.lit(1), (F.size("names") - need + 1).cast("int")), lambda s: s["t"])
    ).drop("_hot")


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row per name prefix token."""
    return nodes.select("*", F.explode("prefix").alias("tok"))


def _with_city(blocks: DataFrame) -> DataFrame:
    return blocks.select("*", F.explode("cities").alias("ctok"))


def _match(threshold: float) -> Column:
    """Verify a candidate pair once, at the first block the two sides share."""
    first_name = F.get(F.array_intersect(F.col("a.prefix"), F.col("b.prefix")), F.lit(0)) == F.col("a.tok")
    na, nb = F.size("a.names"), F.size("b.names")
    sizes = (na >= nb * threshold - 1e-9) & (nb >= na * threshold - 1e-9)
    return first_name & sizes & (T.jaccard(F.col("a.names"), F.col("b.names")) >= threshold)


def matching_pairs(left: DataFrame, right: DataFrame, threshold: float = V.NAME_JACCARD) -> DataFrame:
    """Pairs ``a`` before ``b`` of one date with similar names and compatible cities.

    Candidates meet on (date, rare name token, city token); sides without a
    city, which fit any, meet on (date, rare name token).
    """
    verify = (F.col("a.ord") < F.col("b.ord")) & _match(threshold)
    a, b = _blocks(left), _blocks(right)
    first_city = F.get(F.array_intersect(F.col("a.cities"), F.col("b.cities")), F.lit(0)) == F.col("a.ctok")
    same = ["date", "tok"]

    def on(*names):
        return reduce(lambda x, y: x & y, [F.col(f"a.{n}") == F.col(f"b.{n}") for n in names])

    out = [F.col("a.date").alias("date"), F.col("a.ord").alias("a"), F.col("b.ord").alias("b")]
    open_a, open_b = a.filter(F.size("cities") == 0), b.filter(F.size("cities") == 0)
    closed_a = a.filter(F.size("cities") > 0)
    return (
        _with_city(a).alias("a").join(_with_city(b).alias("b"), on(*same, "ctok") & verify & first_city).select(*out)
        .unionAll(open_a.alias("a").join(b.alias("b"), on(*same) & verify).select(*out))
        .unionAll(closed_a.alias("a").join(open_b.alias("b"), on(*same) & verify).select(*out))
    )


def _dense_dates(nodes: DataFrame, budget: float) -> DataFrame:
    """Dates whose nodes have more than ``budget`` candidate comparisons, and the order value that ends their head.

    A head of sqrt(2 * budget) nodes has at most ``budget`` pairs.
    """
    blocks = _blocks(nodes.select("date", "ord", "prefix", "cities"))
    one, n, unset = F.count(F.lit(1)), F.col("n"), F.count_if(F.size("cities") == 0)
    closed = _with_city(blocks).groupBy("date", "tok", "ctok").agg(one.cast("double").alias("n")).select("date", (n * (n - 1) / 2).alias("c"))
    loose = blocks.groupBy("date", "tok").agg(one.cast("double").alias("n"), unset.cast("double").alias("e")).select(
        "date", (F.col("e") * (n - 1)).alias("c"))
    dense = closed.unionAll(loose).groupBy("date").agg(F.sum("c").alias("c")).filter(F.col("c") > budget).select("date")
    head = max(1.0, math.sqrt(2 * budget))
    shares = [2.0 ** -k for k in range(31)]
    sizes = nodes.join(dense, "date", "left_semi").groupBy("date").agg(
        F.min("ord").alias("first"), F.percentile_approx("ord", shares, 100_000).alias("cuts"), one.alias("n"))
    at = F.greatest(F.lit(1), F.least(F.lit(31), F.ceil(F.log2(n / F.lit(head))) + 1)).cast("int")
    return sizes.select("date", F.greatest("first", F.element_at("cuts", at)).alias("head_end"))


def _greedy(edges: pd.DataFrame) -> pd.DataFrame:
    """Sequential rule over whole components: (b, a) for each absorbed b."""
    absorbed: dict[int, int] = {}
    done = None
    for a, b in edges.sort_values(["b", "a"])[["a", "b"]].itertuples(index=False):
        if b != done and a not in absorbed:
            absorbed[b] = a
            done = b
    return pd.DataFrame({"b": list(absorbed), "a": list(absorbed.values())}, columns=["b", "a"]).astype("int64")


def _anti(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    return df.join(keys.select(F.col("b").alias(column)), column, "left_anti")


def _by_rounds(edges: DataFrame, local_edges: int) -> list[DataFrame]:
    """Tables of absorbed nodes ``b`` of components too large for one task.

    All of them go by rounds together: nodes without an open earlier neighbour
    lead, their neighbours drop out, until what is left of a component is small.
    """
    open_edges, solved = edges, []
    while True:
        big = stage(open_edges.groupBy("comp").count().filter(F.col("count") > local_edges).select("comp"), "large-comps")
        rest = open_edges.join(big, "comp", "left_anti")
        solved.append(rest.groupBy("comp").applyInPandas(_greedy, "b long, a long").select("b"))
        if big.isEmpty():
            return solved
        open_edges = open_edges.join(big, "comp", "left_semi")
        later = open_edges.select("b").distinct()
        roots = open_edges.select("a").distinct().join(later.select(F.col("b").alias("a")), "a", "left_anti")
        hit = stage(open_edges.join(roots, "a", "left_semi").select("b").distinct(), "hit")
        solved.append(hit)
        open_edges = stage(_anti(_anti(open_edges, hit, "a"), hit, "b"), "open-edges")


def solve_edges(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Absorbed nodes and their leaders ``(b, a)`` from materialised match edges.

    A date with at most ``local_edges`` edges is one task's work.  The graph of
    a larger date is cut into its connected components, which don't depend on
    each other: they are packed by edges into bins of about ``local_edges``,
    one task each.  Only a component that is itself larger goes by rounds.
    """
    sizes = stage(edges.groupBy("date").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > local_edges), "large-dates")
    small = edges.join(sizes, "date", "left_anti").groupBy("date").applyInPandas(_greedy, "b long, a long")
    if sizes.isEmpty():
        return small
    many = edges.join(sizes, "date")
    comps = component_labels(many).select(F.col("node").alias("b"), "comp")
    many = stage(many.join(comps, "b"), "many")
    own = many.groupBy("comp").agg(F.count(F.lit(1)).alias("own")).filter(F.col("own") > local_edges).select("comp")
    hard = stage(many.join(own, "comp", "left_semi"), "hard-edges")
    bins = F.ceil(F.col("n") / max(local_edges, 1)).cast("int")
    packed = many.join(own, "comp", "left_anti").withColumn("bin", F.pmod(F.xxhash64("comp"), bins))
    small = small.unionByName(packed.groupBy("date", "bin").applyInPandas(_greedy, "b long, a long"))
    if hard.isEmpty():
        return small
    gone = stage(reduce(DataFrame.unionAll, _by_rounds(hard, local_edges)), "gone")
    return small.unionByName(_anti(hard.select("a", "b"), gone, "a").groupBy("b").agg(F.min("a").alias("a")))


def leader_links(
    nodes: DataFrame, threshold: float = V.NAME_JACCARD,
    pair_budget: float = PAIR_BUDGET, local_edges: int = LOCAL_EDGES,
) -> DataFrame:
    """``(b, a)``: order of each absorbed node and of its leader.

    Dates are independent.  Those within ``pair_budget`` comparisons are solved
    at once.  A denser date takes its nodes in order, a head at a time, so that
    a crowd of near copies is never paired with itself: its leader is found in
    the head and absorbs the rest in one leader-against-rest join.  All dense
    dates share a round; the number of rounds is that of the densest date.
    """
    links = []
    waiting = stage(_with_prefix(nodes, threshold), "nodes")
    while True:
        dense = stage(_dense_dates(waiting, pair_budget), "dense")
        sparse = waiting.join(dense, "date", "left_anti")
        links.append(solve_edges(stage(matching_pairs(sparse, sparse, threshold), "edges"), local_edges))
        if dense.isEmpty():
            break
        many = waiting.join(dense, "date")
        head, rest = (many.filter(c).drop("head_end") for c in ("ord <= head_end", "ord > head_end"))
        inside = stage(solve_edges(stage(matching_pairs(head, head, threshold), "edges"), local_edges), "inside")
        taken = stage(matching_pairs(_anti(head, inside, "ord"), rest, threshold).groupBy("b").agg(F.min("a").alias("a")), "taken")
        links += [inside, taken]
        waiting = stage(_anti(rest, taken, "ord"), "nodes")
    return reduce(DataFrame.unionByName, [x.select("b", "a") for x in links])


def fuzzy_nodes(groups: DataFrame) -> DataFrame:
    """Composite groups with equal token sets share one node: they match the same groups."""
    return (
        _signature(groups.filter(F.col("phase") == 2))
        .groupBy("date", "names", "cities").agg(F.min("first_ord").alias("ord"))
    )


def fuzzy_pairs(groups: DataFrame, threshold: float = V.NAME_JACCARD) -> DataFrame:
    """Every matching pair of distinct signatures, earlier one first.

    The grouping itself does not use this list; see ``leader_links``.
    """
    nodes = stage(_with_prefix(fuzzy_nodes(groups), threshold), "nodes")
    return matching_pairs(nodes, nodes, threshold)


def lead_date(names: list[frozenset], cities: list[frozenset], threshold: float) -> list[int]:
    """For each group of one date, in order, the place of its leader (its own if it leads).

    Only leaders that share one of the rarest name tokens are compared: two
    sets with Jaccard >= t share a token among the first ``n - ceil(t*n) + 1``
    of each, whatever common order is used.
    """
    often = Counter(t for n in names for t in n)
    known: dict[tuple, int] = {}
    led: dict[str, list[int]] = {}
    out = []
    for i, (name, city) in enumerate(zip(names, cities, strict=True)):
        if (leader := known.get((name, city))) is None:
            ranked = sorted(name, key=lambda t: (often[t], t))
            prefix = ranked[: len(name) - math.ceil(len(name) * threshold - 1e-9) + 1]
            leader = i
            for j in sorted({j for t in prefix for j in led.get(t, ())}):
                shared = len(name & names[j])
                if shared / (len(name) + len(names[j]) - shared) >= threshold and not (city and cities[j] and city.isdisjoint(cities[j])):
                    leader = j
                    break
            if leader == i:
                for t in prefix:
                    led.setdefault(t, []).append(i)
            known[name, city] = leader
        out.append(leader)
    return out


def _lead_date(threshold: float):
    def run(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values("first_ord", ignore_index=True)
        at = lead_date(list(map(frozenset, groups["names"])), list(map(frozenset, groups["cities"])), threshold)
        return groups.drop(columns=["names", "cities"]).assign(group_id=groups["first_ord"].to_numpy()[at])

    return run


def _led(signed: DataFrame, columns: list[str], threshold: float, **limits) -> DataFrame:
    """``group_id`` of the groups of large dates, over their match graph."""
    nodes = stage(signed.groupBy("date", "names", "cities").agg(F.min("first_ord").alias("ord")), "nodes")
    links = leader_links(nodes, threshold, **limits).select(F.col("b").alias("ord"), F.col("a").alias("leader"))
    led = nodes.join(links, "ord", "left").select("date", "names", "cities", F.coalesce("leader", "ord").alias("group_id"))
    return signed.join(led, ["date", "names", "cities"]).select(*columns, "group_id")


def group_ids(groups: DataFrame, threshold: float = V.NAME_JACCARD, local_nodes: int = LOCAL_NODES, **limits) -> DataFrame:
    """Exact groups (a stored table) with their final ``group_id``: the first row's order of the leading group."""
    composite = groups.filter(F.col("phase") == 2)
    exact = groups.filter(F.col("phase") == 1).withColumn("group_id", F.col("first_ord"))
    signed = _signature(composite)
    large = composite.groupBy("date").count().filter(F.col("count") > local_nodes).select("date")
    if not large.isEmpty():
        large = stage(large, "large-dates")
        exact = exact.unionByName(_led(signed.join(large, "date", "left_semi"), groups.columns, threshold, **limits))
        signed = signed.join(large, "date", "left_anti")
    schema = StructType([*groups.schema.fields, StructField("group_id", LongType())])
    alone = signed.groupBy("date").applyInPandas(_lead_date(threshold), schema)
    return exact.unionByName(alone)
