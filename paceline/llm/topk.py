"""Exact top-k inner products: vectors by descending length, rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from paceline.llm.common import Staged, keeping, query, table

#: Vectors in a block, and queries in a block.
BLOCK, QUERY_BLOCK = 4096, 512
#: Rotated components that are summed before a bound is tried.
HEAD = 16
#: Scores may come up to this, by the lengths of vectors; a little below what a long holds, as lengths are rounded.
LARGEST = float(1 << 63) * (1 - 1e-9)
#: Relative slack of bounds for rounding in floating point.
SLACK = 1e-6

PACKED = "part int, n int, top double, ids binary, data binary"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as longs; NULL if the vector or a component is NULL or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return F.when(~bad, whole)


def _padded(lists: pa.ListArray, width: int) -> np.ndarray:
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[row, place] = lists.flatten().to_numpy()
    return out


def _gram(width: int):
    def run(frames):
        total = np.zeros((width, width))
        for f in frames:
            x = _padded(f.column("v"), width).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["at", "value"])

    return run


def _pack(width: int, most: int, kind):
    """Rows of one partition, in order, as blocks of at most ``most`` vectors."""

    def run(frames):
        ids, rows, held = [], [], 0
        part = None

        def block():
            v, i = np.concatenate(rows), np.concatenate(ids)
            top = float(np.sqrt((v.astype(float) ** 2).sum(1).max()))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([len(i)], pa.int32()), pa.array([top]), pa.array([i.tobytes()], pa.binary()),
                 pa.array([v.astype(kind).tobytes()], pa.binary())], names=["part", "n", "top", "ids", "data"])

        for f in frames:
            if not f.num_rows:
                continue
            part = f.column("part")[0].as_py()
            v, i = _padded(f.column("v"), width), f.column("id").to_numpy()
            for b in range(0, len(i), most):
                if held and held + len(i[b : b + most]) > most:
                    yield block()
                    ids, rows, held = [], [], 0
                ids.append(i[b : b + most])
                rows.append(v[b : b + most])
                held += len(ids[-1])
        if held:
            yield block()

    return run


def _best(q_ids, q, v_ids, v, turn, k, least):
    """For each query its k best of one block: places of query and vector, and score; ``least``: scores to reach."""
    qf, vf = q.astype(float), v.astype(float)
    qr, vr = qf @ turn, vf @ turn
    head = qr[:, :HEAD] @ vr[:, :HEAD].T
    rest = np.linalg.norm(qr[:, HEAD:], axis=1)[:, None] * np.linalg.norm(vr[:, HEAD:], axis=1)[None]
    slack = 1 + SLACK * np.linalg.norm(qf, axis=1)[:, None] * np.linalg.norm(vf, axis=1)[None]
    can = (head + rest + slack >= least[:, None]) & (q_ids[:, None] != v_ids[None])
    at, to = np.nonzero(can)
    out = []
    for b in range(0, len(at), 1 << 16):
        out.append(np.einsum("ij,ij->i", q[at[b : b + (1 << 16)]], v[to[b : b + (1 << 16)]]))
    score = np.concatenate(out) if out else np.empty(0, np.int64)
    order = np.lexsort((v_ids[to], -score, at))
    at, to, score = at[order], to[order], score[order]
    first = np.searchsorted(at, at)
    keep = np.arange(len(at)) - first < k
    return at[keep], to[keep], score[keep]


def _matrix(cell: pa.Scalar, n: int, kind) -> np.ndarray:
    return np.frombuffer(cell.as_py(), kind).reshape(n, -1)


def _seed(turn: np.ndarray, k: int, tops: np.ndarray, kind):
    """The score each query of a block must reach, and how many parts of the vectors can hold it."""

    def run(frames):
        for f in frames:
            out = []
            for r in range(f.num_rows):
                n, m = f.column("qn")[r].as_py(), f.column("n")[r].as_py()
                q_ids, q = _matrix(f.column("qids")[r], n, np.int64)[:, 0], _matrix(f.column("qdata")[r], n, kind).astype(np.int64)
                v_ids, v = _matrix(f.column("ids")[r], m, np.int64)[:, 0], _matrix(f.column("data")[r], m, kind).astype(np.int64)
                at, _, score = _best(q_ids, q, v_ids, v, turn, k, np.full(n, -np.inf))
                count = np.bincount(at, minlength=n)
                last = np.cumsum(count) - 1
                least = np.full(n, -np.inf)
                least[count == k] = score[last[count == k]]
                reach = np.linalg.norm(q.astype(float), axis=1)[:, None] * tops[None] * (1 + SLACK) + 1
                parts = np.flatnonzero((reach >= least[:, None]).any(0))
                out.append((f.column("q")[r].as_py(), int(parts[-1]) if len(parts) else -1, least.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()),
                 pa.array([o[2] for o in out], pa.binary())], names=["q", "last", "least"])

    return run


def _meet(turn: np.ndarray, k: int, kind):
    """The best pairs of each block of queries and block of vectors."""

    def run(frames):
        for f in frames:
            for r in range(f.num_rows):
                n, m = f.column("qn")[r].as_py(), f.column("n")[r].as_py()
                q_ids, q = _matrix(f.column("qids")[r], n, np.int64)[:, 0], _matrix(f.column("qdata")[r], n, kind).astype(np.int64)
                v_ids, v = _matrix(f.column("ids")[r], m, np.int64)[:, 0], _matrix(f.column("data")[r], m, kind).astype(np.int64)
                at, to, score = _best(q_ids, q, v_ids, v, turn, k, _matrix(f.column("least")[r], n, np.float64)[:, 0])
                row = (f.column("q")[r].as_py() << 16) + at  # a query row, also where ids repeat
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row), pa.array(q_ids[at]), pa.array(v_ids[to]), pa.array(score)],
                    names=["row", "query_id", "vec_id", "score"])

    return run


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
                       block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows with the largest quantised inner product for each query row, itself left out.

    Returns query_id, rank, vec_id, score; ties go to the smaller id.

    Rows are sorted by descending length and cut into blocks.  Each block of
    queries first meets the longest vectors, which gives every query a score to
    reach; it then goes only to blocks whose longest vector can reach it, and
    there only pairs whose partial sum over the first components of a rotation
    (the data's singular vectors) plus the bound on the rest can.  Scores are
    exact whole numbers.

    Pairs of blocks are the join key, so that no row meets another by itself;
    the only broadcast is one block.  The driver gets a matrix of the vectors'
    width and one number a block.

    Vectors that are NULL or hold NULL or non-finite components take no part,
    nor do NULL ids; shorter vectors count as filled up with zeros; components
    keep their values, and where a query and a vector are so long that a score
    might not fit a long, an error is raised; repeated ids are rows of their own (a query
    leaves out all rows of its id); empty input gives no rows.
    """
    staged = Staged(vectors.sparkSession, "topk")
    rows = keeping(vectors, {"id": F.col(vec_id).cast("long"), "v": quantised(F.col(vector)), "ask": F.coalesce(is_query, F.lit(False))})
    rows = rows.filter("id IS NOT NULL AND v IS NOT NULL")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = staged.put("rows", rows.withColumn("norm", norm))
    zero = lambda x: F.coalesce(F.max(x), F.lit(0))
    count, width, top, top_asked = rows.agg(
        F.count(F.lit(1)), zero(F.size("v")), zero("norm"), zero(F.when(F.col("ask"), F.col("norm")))).first()
    width = max(int(width), 1)
    if math.sqrt(top) * math.sqrt(top_asked) >= LARGEST:
        raise ValueError("the vectors are too long for whole-number scores of 64 bits")
    kind = np.int32 if top < 1 << 60 else np.int64
    sums = rows.select("v").mapInArrow(_gram(width), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    gram = np.zeros(width * width)
    gram[sums.column("at").to_numpy()] = sums.column("value").to_numpy()
    turn = np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1].copy()

    # Sorting by id too splits runs of equal length.
    parts = max(1, -(-int(count) // block))
    numbered = rows.repartitionByRange(parts, F.col("norm").desc(), "id").sortWithinPartitions(F.col("norm").desc(), "id")
    packed = staged.put("blocks", numbered.select(F.spark_partition_id().alias("part"), "id", "v").mapInArrow(_pack(width, block, kind), PACKED))
    longest = {r["part"]: r["top"] for r in packed.groupBy("part").agg(F.max("top").alias("top")).toLocalIterator()}
    tops = np.array([longest.get(p, 0.0) for p in range(max(longest, default=-1) + 1)])

    asking = rows.filter("ask").withColumn("part", F.spark_partition_id()).select("part", "id", "v")
    queries = staged.put("queries", asking.mapInArrow(_pack(width, query_block, kind), PACKED).select(
        F.monotonically_increasing_id().alias("q"), F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("data").alias("qdata")))
    block_one = packed.orderBy(F.desc("top"), "part").limit(1).select("n", "ids", "data")
    seeds = queries.withColumn("one", F.lit(1)).join(
        F.broadcast(block_one.withColumn("one", F.lit(1))), "one")
    seeds = seeds.mapInArrow(_seed(turn, k, tops, kind), "q long, last int, least binary")
    visits = queries.join(seeds.filter("last >= 0"), "q").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last"))))
    met = visits.drop("last").join(packed.select("part", "n", "ids", "data"), "part").mapInArrow(
        _meet(turn, k, kind), "row long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = """
WITH v AS (SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS query_id, b.id AS vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op2_exact_topk", TOPK_SQL)
def op2_exact_topk(spark, sf_dir):
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
