"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from paceline.llm.common import keeping, query, table
from paceline.llm.words import Words, batches, mix, texts_of

#: Rows of the vector table: hashed word forms, then hashed word shapes.
FORMS, SHAPES = 8192, 1024
DIM, NONZERO = 32, 2
#: Labelled rows the network is fitted on, at most; those with the least hashes of their id.
FIT_ROWS = 40_000
HIDDEN, EPOCHS, RATE, DECAY, SEED = 32, 40, 3e-3, 1e-4, 7
KEEP = 0.7
#: Words before that are searched for a repeat.
REPEAT = 8
#: Words whose vectors are in memory together.
SLICE = 32_768


def _classes() -> np.ndarray:
    """Small letters, capitals, digits, beyond ASCII; any other character is a class of its own."""
    out = np.arange(256)
    out[97:123], out[65:91], out[48:58], out[128:] = 1, 2, 3, 4
    return out


CLASSES = _classes()


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each row of the table its sparse random index vector: places and signs."""
    code = mix(np.arange((FORMS + SHAPES) * NONZERO, dtype=np.uint64) + np.uint64(1 << 40)).reshape(-1, NONZERO)
    return (code % np.uint64(DIM)).astype(np.int64), np.where(code >> np.uint64(63), 1.0, -1.0)


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Form and shape (rows of the vector table) of every word."""
    hashes = words.hashes()
    raw = CLASSES[words.raw]
    first, last = raw[words.start], raw[words.stop - 1]
    long = words.stop - words.start > 1
    second = np.where(long, raw[np.minimum(words.start + 1, len(raw) - 1)], 0)
    before = np.where(long, raw[words.stop - 2], 0)
    text = np.repeat(np.arange(len(words.first) - 1), words.counts)
    again = np.zeros(len(hashes), bool)
    for k in range(1, REPEAT + 1):
        again[k:] |= (hashes[k:] == hashes[:-k]) & (text[k:] == text[:-k])
    shape = (((first * 256 + second) * 256 + before) * 256 + last) * 2 + again
    form = (hashes % np.uint64(FORMS)).astype(np.int64)
    return form, FORMS + (mix(shape.astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)


def _contexts(frames):
    """Sums of index vectors around each word, of one task's texts."""
    place, sign = index_vectors()
    total = np.zeros((FORMS + SHAPES) * DIM)
    for frame in batches(frames):
        words = Words(texts_of(frame))
        form, shape = tokens(words)
        text = np.repeat(np.arange(frame.num_rows), words.counts)
        near = text[1:] == text[:-1]
        left, right = np.flatnonzero(near), np.flatnonzero(near) + 1
        pairs = [(form, shape)]
        for own in (form, shape):
            for other in (form, shape):
                pairs += [(own[left], other[right]), (own[right], other[left])]
        for own, other in pairs:
            for z in range(NONZERO):
                total += np.bincount(own * DIM + place[other, z], sign[other, z], len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "value"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vector table (FORMS + SHAPES rows of DIM), from all texts; its size doesn't depend on them."""
    sums = docs.mapInArrow(_contexts, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((FORMS + SHAPES) * DIM)
    out[sums.column("at").to_numpy()] = sums.column("value").to_numpy()
    out = out.reshape(-1, DIM)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(words: Words, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a text's word vectors, mean of its shape vectors, log of its length.

    Vectors are looked up for ``SLICE`` words at a time, so that a long text's
    are never in memory together.
    """
    form, shape = tokens(words)
    n = words.counts
    text = np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), 3 * DIM + 1))
    for b in range(0, len(form), SLICE):
        of = text[b : b + SLICE]
        at = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        own = vectors[form[b : b + SLICE]]
        for low, part in ((0, own), (DIM, own * own), (2 * DIM, vectors[shape[b : b + SLICE]])):
            out[of[at], low : low + DIM] += np.add.reduceat(part, at, dtype=np.float64)
    some = np.flatnonzero(n)
    out[some, :-1] /= n[some][:, None]
    out[:, DIM : 2 * DIM] = np.sqrt(np.maximum(out[:, DIM : 2 * DIM] - out[:, :DIM] ** 2, 0))
    out[:, -1] = np.log1p(n) / 5
    return out


@dataclass
class Network:
    """Two layers over standardised inputs; ``heat`` divides the output before the logistic."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    heat: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.heat, -50, 50)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit_network(x: np.ndarray, y: np.ndarray) -> Network:
    """Fit on four fifths of the rows, calibrate on the rest.  Without rows all scores are one half."""
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(y) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    net = Network(mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    p = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - mean) / scale
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in np.array_split(rng.permutation(used), max(1, len(used) // 256)):
            if not len(at):
                continue
            h = np.tanh(z[at] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - y[at]) / len(at)
            dh = d[:, None] * p[2] * (1 - h**2)
            grads, t = [z[at].T @ dh + DECAY * p[0], dh.sum(0), h.T @ d + DECAY * p[2], d.sum(keepdims=True)], t + 1
            for a, g, i in zip(p, grads, range(4), strict=True):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                a -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net.b2 = float(p[3][0])
    if len(held):
        out = net.logits(x[held])
        net.heat = min(np.geomspace(0.25, 8, 61), key=lambda heat: _loss(out / heat, y[held]))
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network
    #: Labelled rows it was fitted on.
    learned: int = 0

    def score(self, docs: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        """``docs`` with a score between 0 and 1 of each whole text."""
        rest = [c for c in docs.columns if c != text]
        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_")).alias("rest"), F.col(text).alias("text"))
        schema = StructType([*packed.schema.fields, StructField("score", DoubleType())])
        model = docs.sparkSession.sparkContext.broadcast(self)
        arrow = to_arrow_schema(schema)

        def run(frames):
            for f in batches(frames):
                x = pooled(Words(texts_of(f)), model.value.vectors)
                yield pa.RecordBatch.from_arrays([*f.columns, pa.array(model.value.network.score(x))], schema=arrow)

        scored = packed.mapInArrow(run, schema)
        return scored.select(*[F.col("text").alias(text) if c == text else F.col("rest").getField(c).alias(c) for c in docs.columns],
                             F.col("score").alias(name))


def _features(vectors):
    def run(frames):
        for f in batches(frames):
            x = pooled(Words(texts_of(f)), vectors.value).astype(np.float32)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([f.column("id"), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["id", "x"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, learn, doc_id: str = "doc_id", text: str = "text",
                label: str = "quality", fit_rows: int = FIT_ROWS) -> QualityModel:
    """A model of ``label`` (0 or 1).

    Word vectors come from all texts: each word form and shape (classes of its
    first and last characters, whether it repeats a near word) sums up the
    random index vectors of its neighbours; forms and shapes are hashed into a
    table of fixed size.  The network is fitted on at most ``fit_rows``
    labelled rows for which ``learn`` (a condition on ``doc_id``) holds.

    NULL texts are empty; rows without id or label are not learned from;
    several labels of one id count as the least; without labels every score is
    one half.  Only the named columns are read.
    """
    rows = keeping(docs, {"id": F.col(doc_id), "text": F.col(text)})
    vectors = word_vectors(rows)
    known = keeping(labels, {"id": F.col(doc_id), "y": F.col(label)}).filter("y IS NOT NULL").groupBy("id").agg(F.min("y").alias("y"))
    known = known.filter(F.coalesce(learn(F.col("id")), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    found = rows.mapInArrow(_features(shared), StructType([rows.schema["id"], StructField("x", ArrayType(FloatType()))])).join(known, "id")
    found = found.orderBy(F.xxhash64("id")).limit(fit_rows).select("x", "y").toArrow()
    x = found.column("x").combine_chunks()
    x = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy().reshape(-1, 3 * DIM + 1).astype(np.float64)
    return QualityModel(vectors, fit_network(x, found.column("y").to_numpy().astype(np.float64)), found.num_rows)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


@query("op9_quality")
def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    scored = model.score(docs)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= KEEP).cast("int").alias("predicted"))
