"""Language-model scoring by context-tree weighting over the bits of bytes."""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log, pi

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from paceline.llm.common import Staged, keeping, query, table
from paceline.llm.lookup import Lookup
from paceline.llm.words import Words, batches, texts_of

#: Bytes of context.
DEPTH = 4
#: Rows of the table that are counted and scored together, and bytes of their texts.
BLOCK_BITS, BLOCK_BYTES = 13, 32 << 20
END, SPACE = 10, 32
#: Stands for the end token among word hashes.
END_KEY = np.uint64(0)

_SMALL = np.array([lgamma(n / 2) if n else 0.0 for n in range(130)])


def _lgamma_halves(twice: np.ndarray) -> np.ndarray:
    """log Gamma(twice / 2) for whole numbers from 1 on."""
    x = np.maximum(twice, 64) / 2.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * log(2 * pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(twice < 128, _SMALL[np.minimum(twice, 129)], series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma_halves(2 * zeros + 1) + _lgamma_halves(2 * ones + 1) - log(pi) - _lgamma_halves(2 * (zeros + ones) + 2)


def streams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All texts as bytes, words with one space between and END behind each text; and where each text begins."""
    data = words.data.copy()
    keep = np.zeros(len(data), bool)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.stop, -1)
    keep[:] = np.cumsum(inside[:-1]) > 0
    data[words.stop] = SPACE
    keep[words.stop] = True
    counts = words.counts
    ends = np.where(counts > 0, words.stop[np.maximum(words.first[1:] - 1, 0)] if len(words.stop) else 0, words.offset[1:] - 1)
    data[ends], keep[ends] = END, True
    at = np.cumsum(keep) - 1
    finish = at[ends] + 1 if len(ends) else np.empty(0, np.int64)
    return data[keep], np.concatenate(([0], finish)).astype(np.int64)


def grams(stream: np.ndarray, begin: np.ndarray, depth: int) -> np.ndarray:
    """Each byte with the ``depth`` bytes before it, the oldest highest; a text is preceded by ENDs."""
    out = stream.astype(np.uint64)
    place = np.arange(len(stream)) - np.repeat(begin[:-1], np.diff(begin))
    for k in range(1, depth + 1):
        before = np.full(len(stream), END, np.uint64)
        before[k:] = stream[:-k]
        before[place < k] = END
        out |= before << np.uint64(8 * k)
    return out


def _sum_by_key(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64)


def _distinct(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, with how often each occurs in training texts."""
    k, n = np.unique(keys[trained], return_counts=True)
    if trained.all():
        return k, n
    rest = np.setdiff1d(keys[~trained], k)
    return np.concatenate((k, rest)), np.concatenate((n, np.zeros(len(rest), n.dtype)))


def _tokens(words: Words, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and ends of some texts, and which of them are for training."""
    keys = np.concatenate((words.hashes(), np.full(len(trained), END_KEY)))
    return keys, np.concatenate((np.repeat(trained, words.counts), trained))


def _numbered(most_rows: int, most_bytes: int, schema: pa.Schema):
    """Rows with the block they are in: consecutive rows of a task, so many or of so many bytes at most; a longer text is alone."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, size = TaskContext.get().partitionId() << 32, 0, 0
        for frame in frames:
            own = []
            for n in pa.compute.fill_null(pa.compute.binary_length(frame.column("text")), 0).to_pylist():
                if rows and (rows == most_rows or size + n > most_bytes):
                    block, rows, size = block + 1, 0, 0
                rows, size = rows + 1, size + n
                own.append(block)
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(own, pa.int64())], schema=schema)

    return run


def _count(depth: int):
    """Distinct keys of each block: byte grams and words."""

    def flush(block, held):
        for kind, (keys, counts) in enumerate(held):
            k, n = _sum_by_key(keys, counts)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(k), block)), pa.array(np.full(len(k), kind == 1)), pa.array(k.view(np.int64)), pa.array(n)],
                names=["block", "word", "key", "n"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, None
        for frame in frames:
            blocks = frame.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for b, e in zip(cuts, cuts[1:], strict=False):
                if e == b:
                    continue
                if held is not None and blocks[b] != block:
                    yield from flush(block, held)
                    held = None
                block, held = int(blocks[b]), held or (([], []), ([], []))
                for part in batches(iter([frame.slice(b, e - b)])):
                    words = Words(texts_of(part))
                    trained = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
                    stream, begin = streams(words)
                    pairs = (_distinct(grams(stream, begin, depth), np.repeat(trained, np.diff(begin))),
                             _distinct(*_tokens(words, trained)))
                    for (keys, counts), (k, n) in zip(held, pairs, strict=True):
                        keys.append(k)
                        counts.append(n)
                        if len(keys) > 8:
                            k, n = _sum_by_key(keys, counts)
                            keys[:], counts[:] = [k], [n]
        if held is not None:
            yield from flush(block, held)

    return run


def _bit(symbol: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The node of the byte's binary tree at which bit j is read, and the bit."""
    symbol = symbol.astype(np.int64)
    return (1 << j) | (symbol >> (8 - j)), (symbol >> (7 - j)) & 1


def weigh(gram: np.ndarray, count: np.ndarray, depth: int, floor: int) -> tuple[np.ndarray, list]:
    """The weighted prediction of every gram's eight bits, from depth ``floor`` down.

    All grams that share their last ``floor`` bytes of context must be here.
    Also returns, for each bit, the nodes at depth ``floor``: key, zeros, ones,
    log of the weighted probability.
    """
    symbol = gram & np.uint64(255)
    context = (gram >> np.uint64(8)).astype(np.int64)
    mixed, tops = np.empty((len(gram), 8)), []
    for j in range(8):
        node, bit = _bit(symbol, j)
        keys, own = np.unique(context << 8 | node, return_inverse=True)
        zeros = np.bincount(own, count * (bit == 0), len(keys)).astype(np.int64)
        ones = np.bincount(own, count * (bit == 1), len(keys)).astype(np.int64)
        levels, below = [], None
        for d in range(depth, floor - 1, -1):
            kt = log_kt(zeros, ones)
            pw = kt if below is None else np.logaddexp(kt, below) + log(0.5)
            levels.append((own, zeros, ones, np.exp(np.minimum(log(0.5) + kt - pw, 0)) if below is not None else None))
            if d == floor:
                tops.append((keys, zeros, ones, pw))
                break
            keys, up = np.unique(keys & ((1 << 8 * d) - 1), return_inverse=True)
            below = np.bincount(up, pw, len(keys))
            zeros, ones = (np.bincount(up, x, len(keys)).astype(np.int64) for x in (zeros, ones))
            own = up[own]
        out = None
        for own, zeros, ones, stop in levels:
            p = (np.where(bit == 0, zeros[own], ones[own]) + 0.5) / ((zeros + ones)[own] + 1.0)
            out = p if stop is None else stop[own] * p + (1 - stop[own]) * out
        mixed[:, j] = out
    return mixed, tops


def _subtrees(depth: int, floor: int):
    """Gram counts of whole subtrees in, their predictions (``top`` false) and top nodes (true) out."""

    def run(frames):
        held = list(frames)
        if not sum(f.num_rows for f in held):
            return
        t = pa.Table.from_batches(held)
        gram, count = t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy()
        mixed, tops = weigh(gram, count, depth, floor)

        def rows(key, top, zeros, ones, pw, x):
            offsets = pa.array(np.arange(len(key) + 1, dtype=np.int32) * (0 if x is None else 8), pa.int32())
            flat = pa.array(np.empty(0) if x is None else x.ravel())
            return pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(np.full(len(key), top)), pa.array(zeros, pa.int64()), pa.array(ones, pa.int64()),
                 pa.array(pw, pa.float64()), pa.ListArray.from_arrays(offsets, flat)],
                names=["key", "top", "zeros", "ones", "pw", "x"])

        nothing = np.zeros(len(gram), np.int64)
        yield rows(gram.view(np.int64), False, nothing, nothing, nothing.astype(float), mixed)
        for keys, zeros, ones, pw in tops:
            yield rows(keys, True, zeros, ones, pw, None)

    return run


class Top:
    """The nodes above the subtrees: no context and one byte of it, at most 255 and 65,280 nodes."""

    def __init__(self, rows):
        one = np.array([(r["key"], r["zeros"], r["ones"]) for r in rows], np.int64).reshape(-1, 3)
        kt, below = log_kt(one[:, 1], one[:, 2]), np.array([r["pw"] for r in rows], float)
        pw = np.logaddexp(kt, below) + log(0.5)
        self.one = self._table(one[:, 0], one[:, 1], one[:, 2], kt, pw, 1 << 16)
        root, up = np.unique(one[:, 0] & 255, return_inverse=True)
        zeros, ones, below = (np.bincount(up, x, len(root)) for x in (one[:, 1], one[:, 2], pw))
        zeros, ones = zeros.astype(np.int64), ones.astype(np.int64)
        kt = log_kt(zeros, ones)
        self.root = self._table(root, zeros, ones, kt, np.logaddexp(kt, below) + log(0.5), 1 << 8)

    @staticmethod
    def _table(keys, zeros, ones, kt, pw, size):
        out = np.zeros((3, size))
        out[:, keys] = zeros, ones, np.exp(np.minimum(log(0.5) + kt - pw, 0))
        return out

    def logs(self, gram: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Log10 probability of each gram's byte."""
        symbol, total = gram & np.uint64(255), np.zeros(len(gram))
        last = ((gram >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
        for j in range(8):
            node, bit = _bit(symbol, j)
            p = mixed[:, j]
            for level, key in ((self.one, last << 8 | node), (self.root, node)):
                zeros, ones, stop = level[:, key]
                own = (np.where(bit == 0, zeros, ones) + 0.5) / (zeros + ones + 1.0)
                p = stop * own + (1 - stop) * p
            total += np.log10(p)
        return total


def _final(top: Top):
    def run(frames):
        for f in frames:
            gram = f.column("key").to_numpy().view(np.uint64)
            x = f.column("x").flatten().to_numpy().reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([f.column("key"), pa.array(top.logs(gram, x))], names=["key", "value"])

    return run


SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double, bits_per_byte double")


def _score(depth: int, total: int, distinct: int):
    def run(texts: pa.Table, values: pa.Table) -> pa.Table:
        is_word = values.column("word").to_numpy().astype(bool)
        keys, got = values.column("key").to_numpy().view(np.uint64), values.column("value").to_numpy()
        # A key that two tasks counted in parts of one block comes twice, with one value.
        (words_at, at), (grams_at, place) = (np.unique(keys[kind], return_index=True) for kind in (is_word, ~is_word))
        word_of, gram_of = Lookup(words_at), Lookup(grams_at)
        word_value, gram_value = got[is_word][at], got[~is_word][place]
        out = []
        for part in (p for b in texts.to_batches() for p in batches(iter([b]))):
            words = Words(texts_of(part))
            stream, begin = streams(words)
            n = part.num_rows
            tokens = _tokens(words, np.zeros(n, bool))[0]
            at, place = word_of.find(tokens), gram_of.find(grams(stream, begin, depth))
            if (at < 0).any() or (place < 0).any():
                raise RuntimeError("a text has a key that was not counted")
            c = word_value[at]
            own = np.concatenate((np.repeat(np.arange(n), words.counts), np.arange(n)))
            base = np.bincount(own, np.log10((c + 1) / (total + distinct + 1)), n)
            size = np.diff(begin)
            score = np.bincount(np.repeat(np.arange(n), size), gram_value[place], n)
            out.append(pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.compute.invert(part.column("train")), pa.array(words.counts + 1, pa.int64()),
                pa.array(np.bincount(own, c > 0, n).astype(np.int64)), pa.array(np.full(n, total)), pa.array(base),
                pa.array(score), pa.array(-score / np.log10(2) / size)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]))
        return pa.Table.from_batches(out)

    return run


def ctw_scores(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH,
               block_bits: int = BLOCK_BITS) -> DataFrame:
    """Log10 probability of every text under a context-tree weighting model of the training texts.

    ``train`` is a condition on the input's columns.  A text is the sequence of
    its lower-cased (A-Z) words with one space between and an end.  A byte is
    eight binary choices; each has its own context tree over the ``depth``
    bytes before.  Node estimates are Krichevsky-Trofimov, mixed over all
    depths by their weighted probabilities; the counts are those of all
    training texts, fixed before any text is scored.  Also returns a base score
    from add-one word frequencies.

    One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, bits_per_byte.

    Rows are stored once, in blocks of consecutive rows of limited number and
    bytes; what is shuffled are each block's distinct byte grams and words, out
    for their counts and back for the scores.  No table of the model is
    collected: the driver holds the top two levels only, 65,535 nodes at most.

    NULL and empty texts are an end; NULL conditions count as training; NULL
    ids and repeated rows are scored as they come; without training texts all
    bits have probability one half; no rows give no rows.
    """
    rows = keeping(docs, {"doc_id": F.col(doc_id).cast("long"), "text": F.col(text),
                          "train": F.coalesce(train, F.lit(True))})
    staged, floor = Staged(docs.sparkSession, "ctw"), 2
    schema = StructType([*rows.schema.fields, StructField("block", LongType())])
    rows = staged.put("rows", rows.mapInArrow(_numbered(1 << block_bits, BLOCK_BYTES, to_arrow_schema(schema)), schema))
    counted = staged.put("counted", rows.mapInArrow(_count(depth), "block long, word boolean, key long, n long"))
    # A key has one row a block at most, however often it occurs.
    same = Window.partitionBy("word", "key")
    totals = staged.put("totals", counted.select(
        "block", "word", "key", F.sum("n").over(same).alias("n"),
        (F.row_number().over(same.orderBy("block")) == 1).alias("first")))
    staged.drop("counted")
    known = totals.filter("word AND first AND n > 0").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    suffix = F.col("key").bitwiseAND((1 << 8 * (floor + 1)) - 1).bitwiseAND(~255)
    parts = totals.filter("NOT word AND first").select("key", "n").repartition(suffix)
    nodes = staged.put("nodes", parts.mapInArrow(
        _subtrees(depth, floor), "key long, top boolean, zeros long, ones long, pw double, x array<double>"))
    top = Top(nodes.filter("top").groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("pw").alias("pw")).collect())
    logs = nodes.filter("NOT top").select("key", "x").mapInArrow(_final(top), "key long, value double")
    values = totals.filter("word").select("block", "word", "key", F.col("n").cast("double").alias("value")).unionByName(
        totals.filter("NOT word").select("block", "word", "key").join(logs, "key"))
    return rows.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(
        _score(depth, int(known["n"]), int(known["v"])), SCORES)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


@query("op4_ctw_scores")
def op4_ctw_scores(spark, sf_dir):
    return ctw_scores(table(spark, sf_dir, "documents"), ~held_out())
