"""Vector code compression: codebooks per part, fitted over Hilbert-sorted blocks that keep boxes and sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import Staged, keeping, query, table

#: Parts of a vector, entries of a part's codebook, rounds of fitting, and the scale of whole components.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Parts of vectors in a block, and bytes of them at most.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Each label's sum is copied so often, to deal a common label's rows over tasks.
SALTS = 16

BLOCKS = "part int, rows binary, kind string, data binary, sums array<long>"


def finite(vector: Column) -> Column:
    """``vector`` as doubles; NULL if it is NULL or holds a NULL or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: x.cast("double")))


def floored(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Components cut down to multiples of 1/scale, a power of two, exactly; large doubles are such multiples already."""
    with np.errstate(over="ignore"):
        return np.where(np.abs(x) < 2.0**50, np.floor(x * scale) / scale, x)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers below 2**bits."""
    x, dims = cells.astype(np.int64).T.copy(), cells.shape[1]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(dims):  # undo the turns of ever smaller cubes
            far = (x[i] & q) != 0
            swap = np.where(far, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(far, q - 1, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(len(cells), np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[-1] & q, q - 1, 0)
    x ^= turn
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _split(width: int, parts: int, centre: np.ndarray, spread: np.ndarray, scale: int):
    """Each vector's parts as rows, with their place on a Hilbert curve through the grid around the first entries."""
    w = width // parts
    dims = min(w, 21)
    bits = min(10, 63 // dims)
    step = max(1, BLOCK_BYTES // (8 * width))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for b in range(0, frame.num_rows, step):
                f = frame.slice(b, step)
                lists = f.column("v")
                size = np.diff(lists.offsets.to_numpy())
                x = np.zeros((len(size), width))
                row = np.repeat(np.arange(len(size)), size)
                x[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
                x = floored(x, scale)
                with np.errstate(all="ignore"):
                    cells = np.nan_to_num((x - centre) / spread + 0.5) * (1 << bits)
                cells = np.clip(np.floor(cells), 0, (1 << bits) - 1).astype(np.int64).reshape(-1, w)
                n = len(size) * parts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(parts, dtype=np.int32), len(size))), pa.array(hilbert_keys(cells[:, :dims], bits)),
                     pa.array(np.repeat(f.column("row").to_numpy(), parts)),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(x.ravel()))],
                    names=["part", "key", "row", "x"])

    return run


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """Floored components times ``scale``: longs if squares of differences are sure to fit, else Python's integers."""
    if not x.size or float(np.abs(x).max()) * scale < _safe(x.shape[-1]):
        return (x * scale).astype(np.int64)
    exact = lambda v: int(v * scale) if abs(v) < 2.0**50 else int(v) * scale
    return np.array([exact(v) for v in x.ravel().tolist()] + [None], object)[:-1].reshape(x.shape)


def _safe(width: int) -> float:
    """Whole numbers below this have squared distances, over ``width`` components, below 2**62."""
    return (2.0**30) / max(1, width) ** 0.5


def _pack(w: int, scale: int):
    """Sorted parts of vectors as flat blocks with their box's corners as first two rows, and sums."""
    most = max(1, min(BLOCK, BLOCK_BYTES // (8 * w)))

    def block(part: int, rows: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        boxed = np.concatenate([x.min(0)[None], x.max(0)[None], x])
        whole = whole_numbers(boxed, scale)
        small = whole.dtype == np.int64
        kind = "<i4" if small and np.abs(whole).max(initial=0) < 1 << 31 else "<f8"
        data = (whole if kind == "<i4" else boxed).astype(kind).tobytes()
        sums = whole[2:].sum(0).tolist() if small else None
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([rows.tobytes()], pa.binary()), pa.array([kind]), pa.array([data], pa.binary()),
             pa.array([sums], pa.list_(pa.int64()))], names=["part", "rows", "kind", "data", "sums"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None  # pieces of the block being filled, and its part
        for f in frames:
            part, rows = f.column("part").to_numpy(), f.column("row").to_numpy()
            x = f.column("x").flatten().to_numpy().reshape(len(rows), w)
            b = 0
            while b < len(rows):
                room = most - sum(len(r) for r, _ in held)
                if held and (part[b] != at or not room):
                    yield block(at, *map(np.concatenate, zip(*held, strict=True)))
                    held, room = [], most
                at = int(part[b])
                e = min(b + room, int(np.searchsorted(part, at, "right")))
                held.append((rows[b:e], x[b:e]))
                b = e
        if held:
            yield block(at, *map(np.concatenate, zip(*held, strict=True)))

    return run


def shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Entries that may be nearest to a point of a box: those not farther at best than another is at worst."""
    near = np.maximum(np.maximum(low - book, book - high), 0)
    far = np.maximum(np.abs(book - low), np.abs(high - book))
    return np.flatnonzero((near * near).sum(1) <= (far * far).sum(1).min())


class _Block:
    """One stored block against the entries of its part's codebook."""

    def __init__(self, f: pa.RecordBatch, r: int, books: list, w: int, scale: int):
        kind = f.column("kind")[r].as_py()
        boxed = np.frombuffer(f.column("data")[r].as_py(), kind).reshape(-1, w)
        self.part, book = f.column("part")[r].as_py(), books[f.column("part")[r].as_py()]
        self.sums = f.column("sums")[r].as_py()
        whole = boxed.astype(np.int64) if kind == "<i4" else whole_numbers(boxed, scale)
        most = max((abs(c) for e in book for c in e), default=0)
        small = kind == "<i4" and max(most, int(np.abs(whole).max(initial=0))) < _safe(w)
        self.whole, self.book = (whole, np.array(book, np.int64)) if small else (whole.astype(object), np.array(book, object))
        self.short = shortlist(self.whole[0], self.whole[1], self.book)
        self.n = len(boxed) - 2

    def nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each point; ties go to the lower entry."""
        gap = self.whole[2:, None, :] - self.book[None, self.short, :]
        distance = (gap * gap).sum(2)
        at = distance.argmin(1)
        return self.short[at], distance[np.arange(self.n), at]


def _assign(books: list, w: int, scale: int):
    """Counts and sums of each entry's points in a task; sums as text, as they may pass 64 bits."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list] = {}

        def add(part: int, entry: int, n: int, sums: list) -> None:
            total = totals.setdefault((part, int(entry)), [0, [0] * w])
            total[0] += n
            total[1] = [a + b for a, b in zip(total[1], sums, strict=True)]

        for f in frames:
            for r in range(f.num_rows):
                b = _Block(f, r, books, w, scale)
                if len(b.short) == 1 and b.sums is not None:  # the whole block is nearest to one entry
                    add(b.part, b.short[0], b.n, b.sums)
                    continue
                entry, _ = b.nearest()
                for e in np.unique(entry):
                    own = b.whole[2:][entry == e]
                    add(b.part, e, len(own), own.sum(0).tolist())
        keys = list(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([totals[k][0] for k in keys], pa.int64()),
             pa.array([[str(s) for s in totals[k][1]] for k in keys], pa.list_(pa.string()))], names=["part", "entry", "n", "sums"])

    return run


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    sums = [str(sum(map(int, column))) for column in zip(*rows["sums"], strict=True)]
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "entry": [rows["entry"].iloc[0]], "n": [rows["n"].sum()], "sums": [sums]})


SUMS = "part int, entry int, n long, sums array<string>"


def _code(books: list, w: int, scale: int):
    """Entry and squared distance of every part of a vector; a distance beyond a long is NULL."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for r in range(f.num_rows):
                b = _Block(f, r, books, w, scale)
                entry, distance = b.nearest()
                if distance.dtype == object:
                    distance = [int(d) if d < 1 << 63 else None for d in distance]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(f.column("rows")[r].as_py(), np.int64)),
                     pa.array(np.full(b.n, b.part, np.int32)), pa.array(entry.astype(np.int64)), pa.array(distance, pa.int64())],
                    names=["row", "part", "entry", "distance"])

    return run


def _long(total: Column, whole: Column) -> Column:
    return F.when(whole, total.try_cast("long"))


class Compressed:
    """``codes``: vec_id, label, code, error, label_error; ``books``: whole components by part, entry and position."""

    def __init__(self, codes: DataFrame, books: list[list[list[int]]], scale: int):
        self.codes, self.books, self.scale = codes, books, scale

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(c) for part in self.books for e in part for c in e).encode()).hexdigest()

    def decoded(self, code: Column) -> Column:
        """The vector that a code stands for."""
        parts = [F.get(F.array(*[F.array(*[F.lit(c / self.scale) for c in e]) for e in book]),
                       F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")) for p, book in enumerate(self.books)]
        return F.concat(*parts)


def compress_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                     parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Compressed:
    """A codebook for each part of the vectors, and every vector as one entry number a part.

    Components are floor(scale * x).  Entries start as the parts of the
    ``entries`` smallest ids and move ``rounds`` times to the floored mean of
    the parts nearest to them.

    Parts of vectors are range-partitioned by their place on a Hilbert curve and
    stored once as blocks of neighbours.  A round compares a block's box with
    the entries: those that can't be nearest to any of its points are left out;
    if one remains, the block's stored sums count as they are; otherwise whole
    distances to the few decide.  A task returns one row an entry, which Spark
    adds up; the driver holds codebooks only.  The curve decides how short the
    lists are, never the result.

    Vectors that are NULL or hold NULL or non-finite components take no part.
    Shorter vectors, and widths that ``parts`` doesn't divide, count as filled
    up with zeros.  NULL ids come last; rows of equal ids are rows of their own,
    the smallest vector first.  Fewer vectors than ``entries`` give that many
    entries.  Sums and distances are exact at any size; an error that no long
    holds is NULL.  No vectors give no rows.
    """
    staged = Staged(vectors.sparkSession, "codes")
    rows = keeping(vectors, {"vec_id": F.col(vec_id), "label": F.col(label), "v": finite(F.col(vector))}).filter("v IS NOT NULL")
    rows = staged.put("rows", rows.select(F.monotonically_increasing_id().alias("row"), "*"))
    width = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    w = max(1, -(-width // parts))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    seeds = floored(np.array([list(r.v) + [0.0] * (w * parts - len(r.v)) for r in first]).reshape(-1, w * parts), scale)
    books = [[whole_numbers(s[p * w : (p + 1) * w], scale).tolist() for s in seeds] for p in range(parts)]

    with np.errstate(all="ignore"):
        centre = seeds.mean(0) if len(seeds) else np.zeros(w * parts)
        spread = np.maximum(5 * np.nan_to_num(seeds.std(0) if len(seeds) else centre), 1 / scale)
    order = ["part", "key", "row"]
    cut = rows.select("row", "v").mapInArrow(_split(w * parts, parts, centre, spread, scale), "part int, key long, row long, x array<double>")
    blocks = staged.put("blocks", cut.repartitionByRange(*order).sortWithinPartitions(*order).select("part", "row", "x").mapInArrow(
        _pack(w, scale), BLOCKS))
    for _ in range(rounds):
        moved = blocks.mapInArrow(_assign(books, w, scale), SUMS).groupBy("part", "entry").applyInPandas(_merged, SUMS)
        for r in moved.collect():  # one row an entry
            books[r.part][r.entry] = [int(s) // r.n for s in r.sums]

    found = blocks.select("part", "rows", "kind", "data", "sums").mapInArrow(
        _code(books, w, scale), "row long, part int, entry long, distance long")
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))), lambda s: F.lower(
        F.lpad(F.hex(s["entry"]), 2, "0"))), "")
    coded = found.groupBy("row").agg(
        digits.alias("code"), _long(F.sum(F.col("distance").cast("decimal(38,0)")), F.count("distance") == parts).alias("error"))
    coded = staged.put("coded", rows.select("row", "vec_id", "label").join(coded, "row"))
    total = _long(F.sum(F.col("error").cast("decimal(38,0)")), F.count("error") == F.count(F.lit(1)))
    sums = coded.groupBy("label").agg(total.alias("label_error")).select(
        F.col("label").alias("same"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of"))
    salt = (F.col("row") % SALTS).cast("int")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("same")) & (salt == F.col("of")))
    return Compressed(out.select("vec_id", "label", "code", "error", "label_error"), books, scale)


def _sql() -> str:
    distance = "list_sum(list_transform(list_zip(p.s, c.s), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    ctes = [f"""v AS (SELECT row_number() OVER () AS row, vec_id, label,
       list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
     FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"""p AS MATERIALIZED (SELECT row, vec_id, part, q[part * (len(q) // {PARTS}) + 1 : (part + 1) * (len(q) // {PARTS})] AS s
     FROM v, (SELECT unnest(range({PARTS})) AS part))""",
            f"""c0 AS MATERIALIZED (SELECT * FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, s FROM p)
     WHERE e < {ENTRIES})"""]
    for n in range(ROUNDS + 1):
        ctes.append(f"""a{n} AS MATERIALIZED (SELECT row, part, min(d) AS d, arg_min(e, d * {ENTRIES} + e) AS e, any_value(s) AS s
     FROM (SELECT p.row, p.part, p.s, c.e, {distance} AS d FROM p JOIN c{n} c ON p.part = c.part) GROUP BY row, part)""")
        if n < ROUNDS:
            ctes.append(f"""m{n} AS (SELECT part, e, list((t - ((t % n) + n) % n) // n ORDER BY i) AS s FROM (
      SELECT part, e, i, sum(s[i])::HUGEINT AS t, count(*) AS n FROM (SELECT part, e, s, generate_subscripts(s, 1) AS i FROM a{n})
      GROUP BY part, e, i) GROUP BY part, e)""")
            ctes.append(f"""c{n + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.s::BIGINT[], c.s) AS s
     FROM c{n} c LEFT JOIN m{n} m ON c.part = m.part AND c.e = m.e)""")
    return "WITH " + ",\n".join(ctes) + f""",
f AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d) AS error FROM a{ROUNDS} GROUP BY row),
r AS (SELECT vec_id, label, code, error FROM v JOIN f USING (row)),
b AS (SELECT label, sum(error) AS total FROM r GROUP BY label),
h AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, e)) AS books FROM c{ROUNDS})
SELECT vec_id, code, error::BIGINT AS error, total::BIGINT AS label_error, books AS codebooks_sha256
FROM r JOIN b ON r.label IS NOT DISTINCT FROM b.label, h"""


CODES_SQL = _sql()


@query("op12_vector_codes", CODES_SQL)
def op12_vector_codes(spark, sf_dir):
    found = compress_vectors(table(spark, sf_dir, "embeddings"))
    return found.codes.select("vec_id", "code", "error", "label_error", F.lit(found.sha256).alias("codebooks_sha256"))
