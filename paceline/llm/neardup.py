"""MinHash near-duplicates: bottom-k sketches of one hash function, inverted lists, exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from paceline.llm.common import Staged, keeping, query, table
from paceline.llm.components import connected
from paceline.llm.words import Words, batches, mix, shingles, texts_of

SKETCH = 64
#: Chance, at most, that a pair at the very threshold shares fewer sketch values than asked for.
MISS = 1e-9
#: Members of one block where the rest of a group is compared block by block.
BLOCK = 1024
#: Columns of a block's incidence matrix that are multiplied at once.
COLUMNS = 4096

#: Lists of so many members or fewer count pairs instead of electing a leader.
SHORT = 4
#: Bits of the marks (4 MB) that keep most unwanted texts from being moved.
MARKS = 1 << 25
#: A group's rows are dealt to so many join keys, and what is known of the group is copied to each.
SALTS = 16

SIGNS = "id long, n long, k1 long, k2 long, sketch array<long>"
SETS = "node long, shingles array<long>"


def sets_of(frame: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a batch."""
    words = Words(texts_of(frame))
    hashes = words.hashes()
    runs = shingles(hashes, width) if len(hashes) >= width else hashes[:0]
    for b, e in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        own = runs[b : e - width + 1] if e - b >= width else shingles(hashes[b:e], width)
        yield np.unique(own.view(np.int64))


def _keys(s: np.ndarray) -> tuple[int, int]:
    u = s.view(np.uint64)
    return int(mix(u ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64).sum()), int(mix(u ^ np.uint64(0x14057B7EF767814F)).view(np.int64).sum())


def _sign(width: int, k: int):
    def run(frames):
        for frame in batches(frames):
            sets = list(sets_of(frame, width))
            keys = [_keys(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                frame.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in keys], pa.int64()),
                pa.array([b for _, b in keys], pa.int64()), _lists([s[:k] for s in sets])],
                names=["id", "n", "k1", "k2", "sketch"])

    return run


def _whole(width: int):
    """The set of each text that has the wanted keys, once a task for each node."""

    def run(frames):
        seen = set()
        for frame in batches(frames):
            nodes, sets = [], []
            for node, a, b, s in zip(*(frame.column(c).to_pylist() for c in ("node", "k1", "k2")), sets_of(frame, width), strict=True):
                if node not in seen and (a, b) == _keys(s):
                    seen.add(node)
                    nodes.append(node)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _lists(sets)], names=["node", "shingles"])

    return run


def _keyed(width: int):
    def run(frames):
        for frame in batches(frames):
            sets = list(sets_of(frame, width))
            keys = [_keys(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), _lists(sets)],
                names=["k1", "k2", "shingles"])

    return run


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def least_shared(k: int, share: float) -> int:
    """The largest t such that k draws with chance ``share`` give fewer than t with a chance below MISS."""
    below, t = 0.0, 0
    while (below := below + math.comb(k, t) * share**t * (1 - share) ** (k - t)) < MISS:
        t += 1
    return t


def _prefix(k: int, percent: int) -> Column:
    """How many of its sketch values, rarest first, a set must publish.

    Two similar sets share at least t sketch values, so their first
    ``size - t + 1`` in any common order meet, and with one more they meet
    twice if t is two or more.  For a set that its sketch holds whole, t
    follows from the threshold; else it is a tail bound.
    """
    share, n, m = percent / 100, F.col("n"), F.size("sketch")
    whole = F.least(F.ceil(n * percent / 100), k - F.floor(n * (1 - share) / share + 1e-9))
    return m - F.when(n <= k, whole).otherwise(least_shared(k, share)).cast("int") + 1


def _similar(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("long")
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def _likely(a: Column, b: Column, k: int, percent: int) -> Column:
    """Whether the bottom-k sketch of the union still allows for a link."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    need = F.when(F.size(union) < k, F.ceil(F.size(union) * percent / 100)).otherwise(least_shared(k, percent / 100))
    return both >= need


def _salted(rows: DataFrame, known: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``known`` (one row a ``key``), where a key may hold a large part of the rows."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(
        known.withColumn("salt", salts), [key, "salt"], how).drop("salt")


def _marked_ids(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``id`` is not one of ``wanted``'s.

    Wanted ids set bits at their hash; what is broadcast is the bits, whose
    number is fixed.  More ids than bits only let more rows through.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(MARKS))
    marks = wanted.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("place"))
    marks = marks.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    held = rows.withColumns({"bucket": F.bitmap_bucket_number(place), "place": F.bitmap_bit_position(place)}).join(F.broadcast(marks), "bucket")
    byte = "cast(conv(hex(substring(bits, cast(place div 8 as int) + 1, 1)), 16, 10) as int)"
    return held.filter(F.expr(f"(shiftright({byte}, cast(place % 8 as int)) & 1) = 1")).select(*rows.columns)


class NearDuplicates:
    """One run of the operator; see ``near_duplicates``."""

    def __init__(self, docs: DataFrame, width: int, percent: int, k: int):
        self.docs, self.width, self.percent, self.k = docs, width, percent, k
        self.staged = Staged(docs.sparkSession, "neardup")
        self.signs = self.staged.put("signs", docs.mapInArrow(_sign(width, k), SIGNS))
        #: Ids of several rows; their texts are told apart by the keys of their sets.
        self.several = self.staged.put("several", self.signs.filter("id IS NOT NULL").groupBy("id").agg(
            F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("id"))

    def sketches(self) -> DataFrame:
        """One sketch for each distinct set, with the smallest id that has it; equal sets are one node."""
        sets = self.signs.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch"))
        return sets.select(F.monotonically_increasing_id().alias("node"), "*")

    def lists(self, sketches: DataFrame) -> DataFrame:
        """Inverted lists (value, size, node) of the published values that two nodes or more publish.

        Similar sets differ in size by the factor of the threshold at most, so
        they are in one size class or in neighbouring ones.  A node publishes
        under its class and the next, and a value that only sets of other sizes
        share brings nobody together.  One value more than needed is published,
        so that similar sets share two.
        """
        step = max(math.log(100 / self.percent), 1e-6) * (1 + 1e-9)
        values = sketches.select("node", F.explode("sketch").alias("value"), F.size("sketch").alias("m"),
                                 _prefix(self.k, self.percent).alias("prefix"), F.floor(F.log("n") / step).alias("class"))
        often = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        own = Window.partitionBy("node")
        shared = values.join(often, "value").withColumns({
            "alone": F.col("m") - F.count(F.lit(1)).over(own), "place": F.row_number().over(own.orderBy("df", "value"))})
        published = shared.filter("alone + place <= prefix + 1").select(
            "value", "node", "alone", F.explode(F.array("class", F.col("class") + 1)).alias("size"))
        published = self.staged.put("published", published)
        several = published.groupBy("value", "size").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        return published.join(several, ["value", "size"])

    def whole_sets(self, nodes: DataFrame) -> DataFrame:
        """The full shingle sets of some nodes (node, id, k1, k2)."""
        sole = nodes.join(self.several, "id", "left_anti").filter("id IS NOT NULL")
        named = _marked_ids(self.docs, sole).join(sole, "id").select("node", "k1", "k2", "text").mapInArrow(_whole(self.width), SETS)
        unclear = self.docs.filter("id IS NULL").unionByName(self.docs.join(self.several, "id", "left_semi"))
        keyed = unclear.mapInArrow(_keyed(self.width), f"k1 long, k2 long, {SETS.split(', ')[1]}")
        return named.unionByName(keyed.join(nodes, ["k1", "k2"]).select("node", "shingles").dropDuplicates(["node"]))

    @staticmethod
    def side(df: DataFrame, key: str, column: str) -> DataFrame:
        return df.select(F.col("node").alias(key), F.col(column).alias(f"s{key}"))

    def near_pairs(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) for which the sketch of the union still allows a link."""
        return pairs.join(self.side(sketches, "b", "sketch"), "b").join(self.side(sketches, "a", "sketch"), "a").filter(
            _likely(F.col("sa"), F.col("sb"), self.k, self.percent)).select("a", "b")

    def linked_pairs(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose full sets are similar."""
        return pairs.join(self.side(sets, "b", "shingles"), "b").join(self.side(sets, "a", "shingles"), "a").filter(
            _similar(F.col("sa"), F.col("sb"), self.percent)).select("a", "b")

    def labels_after(self, labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Labels (node, comp) after merging the components that links (a, b) of nodes join."""
        of = lambda key: labels.select(F.col("node").alias(key), F.col("comp").alias(f"c{key}"))
        edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        roots = connected(edges, self.staged, f"{name}-edges").select(F.col("node").alias("comp"), "root")
        return self.staged.put(name, labels.join(roots, "comp", "left").select(
            "node", F.coalesce("root", "comp").alias("comp")))

    def groups(self, lists: DataFrame) -> DataFrame:
        """(lead, node): all nodes that share a long inverted list with the same leader, and pairs that share two short ones.

        Similar sets share two published values.  Either they share a long list,
        then they are in the group of its leader, or all lists they share are
        short: these state their few pairs, and a pair that has only one value
        in common, as strangers do, goes.

        A list's leader is the member with the fewest values of its own, so
        that the lists of one group of copies agree on the text the others were
        made from, and a pair of nodes meets once, not once for each list.
        """
        short = SHORT if self.percent > 50 else 1
        member = F.struct("alone", F.xxhash64("node").alias("draw"), F.col("node").alias("lead"))
        lists = self.staged.put("lists", lists.withColumn("member", member))
        long = lists.filter(F.col("members") > short)
        leads = long.groupBy("value", "size").agg(F.min("member").alias("l"))
        stars = long.join(leads, ["value", "size"]).select(F.col("l.lead").alias("lead"), "node")
        few = lists.filter(F.col("members") <= short).groupBy("value", "size").agg(F.array_sort(F.collect_list("member")).alias("m"))
        last = F.size("m") - 1
        pairs = F.flatten(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.transform(
            F.sequence(i + 1, last), lambda j: F.struct(F.get("m", i)["lead"].alias("lead"), F.get("m", j)["lead"].alias("node")))))
        pairs = few.select("value", F.explode(pairs).alias("p")).groupBy("p.lead", "p.node").agg(
            F.min("value").alias("low"), F.max("value").alias("high")).filter("low < high").select("lead", "node")
        return stars.unionByName(pairs).unionByName(pairs.select("lead", F.col("lead").alias("node"))).distinct()

    def dealt(self, groups: DataFrame, columns: list[str]) -> DataFrame:
        """Members of groups, dealt to pairs of blocks of some ``BLOCK`` members each; a group's pairs are separate tasks' work."""
        sizes = groups.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        member = _salted(groups, sizes, "lead").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        member = member.select("lead", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                               (F.col("own") > F.col("other")).alias("late"), *columns)
        return member.repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j")

    def open_members(self, groups: DataFrame, labels: DataFrame) -> DataFrame:
        """Groups that hold more than one component, with the component of each member."""
        tagged = groups.join(labels, "node")
        open_ = tagged.groupBy("lead").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("lead")
        return _salted(tagged, open_, "lead", "left_semi")

    def likely_members(self, groups: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
        """Members (lead, node) of groups that by their sketch may be linked across components."""
        tagged = self.open_members(groups, labels)
        members = self.dealt(tagged.join(sketches.select("node", "n", F.col("sketch").alias("items")), "node"), ["node", "comp", "n", "items"])
        return members.mapInArrow(_blocks(_likely_members(self.k, self.percent), ["lead", "node"]), "lead long, node long").distinct()

    def rest_links(self, groups: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (a, b) across components by the members' full sets; at most as many as join a block's components."""
        tagged = self.open_members(groups, labels)
        full = self.dealt(tagged.join(sets.select("node", F.size("shingles").cast("long").alias("n"), F.col("shingles").alias("items")), "node"),
                          ["node", "comp", "n", "items"])
        return full.mapInArrow(_blocks(_links(self.percent), ["a", "b"]), "a long, b long").distinct()

    def run(self) -> DataFrame:
        put = self.staged.put
        sketches = put("sketches", self.sketches())
        groups = put("groups", self.groups(self.lists(sketches)))
        self.staged.drop("published", "lists")
        self.staged.tidy()
        single = put("single", groups.select("node", F.col("node").alias("comp")).distinct())

        # What sketches allow: pairs with a leader, and members of what is left when these pairs are taken for links.
        star = groups.filter("lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b"))
        near = put("near", self.near_pairs(star, sketches))
        likely = put("likely", self.likely_members(groups, self.labels_after(single, near, "assumed"), sketches))
        self.staged.tidy()

        # Only these need their full sets.  A pair is in one assumed component, then both are in near pairs, or both are likely members.
        met = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        active = put("active", groups.join(met, "node", "left_semi").select("lead", "node").unionByName(likely).distinct())
        keys = put("keys", sketches.join(active.select("node").distinct(), "node", "left_semi").select("node", "id", "k1", "k2"))
        sets = put("sets", self.whole_sets(keys))
        self.staged.tidy()
        labels = self.labels_after(single, put("star", self.linked_pairs(near, sets)), "starred")
        self.staged.tidy()
        labels = self.labels_after(labels, put("rest", self.rest_links(active, labels, sets)), "labels")
        self.staged.drop("groups", "single", "near", "assumed", "likely", "active", "keys", "sets", "star", "starred", "rest")
        self.staged.tidy()
        return self.members(sketches, labels)

    def members(self, sketches: DataFrame, labels: DataFrame) -> DataFrame:
        """Every row of ``signs`` with its component, and whether its set and id are the ones its component is named after."""
        named = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")
        classes = sketches.select("node", "id", "k1", "k2", "n").join(labels, "node")
        least = self.staged.put("least", classes.groupBy("comp").agg(F.min(named).alias("least")))
        joined = _salted(classes, least, "comp").select("k1", "k2", "n", "least", F.col("comp").alias("of"))
        alone = sketches.join(labels, "node", "left_anti").select("k1", "k2", "n", named.alias("least"), F.col("node").alias("of"))
        rows = self.signs.select("id", "n", "k1", "k2").join(joined.unionByName(alone), ["k1", "k2", "n"], "left")
        stands = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("least.id", F.lit(1 << 62) + F.col("of")))
        first = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("k1") == F.col("least.k1")) & (F.col("k2") == F.col("least.k2"))
        return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), stands.alias("component_id"), "k1", "k2",
                           F.coalesce(first, F.lit(False)).alias("first"))


def _overlaps(items: pa.ListArray, rows: list[np.ndarray]) -> np.ndarray:
    """Numbers of items that each member of rows[0] has in common with each of rows[1]."""
    size = np.diff(items.offsets.to_numpy())
    kinds, code, often = np.unique(items.flatten().to_numpy(), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(size)), size)
    several = often[code] > 1
    owner, code = owner[several], (np.cumsum(often > 1) - 1)[code[several]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    shared = np.zeros((len(rows[0]), len(rows[1])), np.float32)
    for low in range(0, int(often[often > 1].size), COLUMNS):
        b, e = np.searchsorted(code, (low, low + COLUMNS))
        has = np.zeros((len(size), COLUMNS), np.float32)
        has[owner[b:e], code[b:e] - low] = 1
        shared += has[rows[0]] @ has[rows[1]].T
    return shared


def _likely_members(k: int, percent: int):
    least = least_shared(k, percent / 100)

    def judge(t, a, b, node, comp, n, same):
        shared = _overlaps(t.column("items").combine_chunks(), [a, b])
        low, high = np.minimum(n[a][:, None], n[b][None]), np.maximum(n[a][:, None], n[b][None])
        # Two whole sets are compared in full; a sketch of a larger set may lack some of the common values.
        need = np.where(high <= k, np.ceil(high * percent / 100), np.minimum(least, k - np.floor(low * (100 - percent) / percent)))
        need = np.where((high > k) & (low > k), least, need)
        good = (shared >= need) & (100 * low >= percent * high) & (comp[a][:, None] != comp[b][None])
        members = np.unique(np.concatenate((a[good.any(1)], b[good.any(0)])))
        return np.full(len(members), t.column("lead")[0].as_py()), node[members]

    return judge


def _links(percent: int):
    def judge(t, a, b, node, comp, n, same):
        shared = _overlaps(t.column("items").combine_chunks(), [a, b])
        x, y = np.nonzero(100 * shared >= percent * (n[a][:, None] + n[b][None] - shared))
        root = {}

        def find(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        out = []
        for p, q in zip(a[x].tolist(), b[y].tolist(), strict=True):
            u, v = find(comp[p]), find(comp[q])
            if u != v:
                root[u] = v
                out.append((node[p], node[q]))
        return tuple(np.array(out, np.int64).reshape(-1, 2).T)

    return judge


def _blocks(judge, names: list[str]):
    """Runs ``judge`` on each pair of blocks; a task's rows come sorted by pair."""

    def emit(group):
        t = pa.Table.from_batches(group)
        node, comp, n = (t.column(c).to_numpy() for c in ("node", "comp", "n"))
        late, same = t.column("late").to_numpy().astype(bool), t.column("i")[0].as_py() == t.column("j")[0].as_py()
        a = np.flatnonzero(~late)
        x, y = judge(t, a, a if same else np.flatnonzero(late), node, comp, n, same)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=names)

    def run(frames):
        held, key = [], None
        for frame in frames:
            ids = [frame.column(c).to_numpy() for c in ("lead", "i", "j")]
            new = (np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in ids])) + 1).tolist()
            for b, e in zip([0, *new], [*new, frame.num_rows], strict=True):
                if e == b:
                    continue
                at = tuple(int(x[b]) for x in ids)
                if held and at != key:
                    yield emit(held)
                    held = []
                key = at
                held.append(frame.slice(b, e - b))
        if held:
            yield emit(held)

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
                    sketch: int = SKETCH) -> DataFrame:
    """Components of documents whose sets of word shingles are similar.

    Words are lower-cased (A-Z) runs without ASCII white space.  A document's
    set holds its distinct ``words``-word shingles, or the whole sequence if it
    is shorter.  Documents are linked if 100 * intersection >= ``percent`` *
    union, on full sets.  Returns one row per input row: doc_id, n_shingles,
    component_id (smallest id reachable), k1 and k2 (128 bits that stand for
    the set), first (whether the row has the set and id that its component is
    named after).

    Equal sets collapse first.  Each remaining set keeps the ``sketch`` least
    hashes of its shingles; inverted lists of these values, rarest first, bring
    candidates together; the sketch of the union and then the full sets judge
    them.  Each group is linked through its leader first; what it then still
    holds across components is compared block by block.  A pair at the
    threshold is overlooked with a chance below 1e-9; a ``sketch`` as large as
    the largest set overlooks none.

    NULL and empty texts have an empty set and are linked with nothing.  Rows
    are told apart by their sets, whatever their ids: rows of one id and unlike
    sets are linked only through what they share.  A component without an id
    gets a number behind all usual ids, an empty text without one none.  No
    rows give no rows.  Ids are whole numbers.  Only the two named columns are
    read.
    """
    rows = keeping(docs, {"id": F.col(doc_id).cast("long"), "text": F.col(text)})
    return NearDuplicates(rows, words, percent, sketch).run()


def _marked(width: int, arrow: pa.Schema):
    def run(frames):
        for f in batches(frames):
            sets = list(sets_of(f, width))
            keys = [_keys(s) for s in sets]
            yield pa.RecordBatch.from_arrays([*f.columns, pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()),
                                              pa.array([len(s) for s in sets], pa.int64())], schema=arrow)

    return run


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: one row of the smallest id and the set it is named after.

    Rows of one id and unlike sets are documents of their own.  Documents
    without words are linked with nothing and all stay, every row of them.
    Documents with a NULL id stay if their component has no id.
    """
    rows = keeping(docs, {"id": F.col(doc_id).cast("long"), "text": F.col(text)})
    run = NearDuplicates(rows, words, percent, SKETCH)
    found = run.run()
    rest = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_")).alias("rest"), F.col(doc_id).cast("long").alias("id"),
                         F.col(text).alias("text"))
    # An id of one row says which row; else the row's set is needed too.
    stay = found.filter("doc_id IS NOT NULL AND (first OR n_shingles = 0)").select(F.col("doc_id").alias("id"))
    sole = packed.join(stay.join(run.several, "id", "left_anti"), "id").select("rest", "text")
    unclear = packed.filter("id IS NULL").unionByName(packed.join(run.several, "id", "left_semi"))
    schema = StructType([*unclear.schema.fields, *[StructField(c, LongType()) for c in ("k1", "k2", "n")]])
    unclear = unclear.mapInArrow(_marked(words, to_arrow_schema(schema)), schema)
    wanted = found.filter("first AND n_shingles > 0").select(F.col("doc_id").alias("id"), "k1", "k2").distinct()
    same = Window.partitionBy("id", "k1", "k2").orderBy(F.xxhash64("text"), "text")
    of = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") == F.col("b.k2"))
    chosen = unclear.filter("n > 0").alias("a").join(wanted.alias("b"), of, "left_semi").withColumn("at", F.row_number().over(same)).filter("at = 1")
    kept = sole.unionByName(chosen.select("rest", "text")).unionByName(unclear.filter("n = 0").select("rest", "text"))
    return kept.select(*[F.col("text").alias(text) if c == text else F.col("rest").getField(c).alias(c) for c in docs.columns])


NEARDUP_WORDS, NEARDUP_PERCENT = 2, 80


@query("op3_minhash_neardup")
def op3_minhash_neardup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), words=NEARDUP_WORDS, percent=NEARDUP_PERCENT)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
