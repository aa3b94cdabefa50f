"""SentencePiece models run by the tokenizers library, with proof of parity."""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from paceline.llm.common import query, table
from paceline.llm.lookup import Memo
from paceline.llm.words import batches, give_back, range_hashes, same_ranges, texts_of

#: A model larger than this is refused, as it is sent to every executor.
MOST_MODEL_BYTES = 64 << 20
#: Distinct stretches a task remembers (some 50 bytes each); it then begins anew.
REMEMBERED = 1_000_000
MARK = "▁"
#: What names of pieces that no text may match begin with: characters that Unicode keeps out of texts.
HIDDEN = "\U0010ffff\ufdd0\U0010fffe\ufdd1" * 4
# Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of a protobuf message: ints, and bytes of everything with a length."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        elif tag & 7 in (1, 5):
            size = 8 if tag & 7 == 1 else 4
            yield tag >> 3, struct.unpack("<d" if size == 8 else "<f", data[at : at + size])[0]
            at += size
        else:
            raise ValueError("not a SentencePiece model")


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                p = dict(_fields(value))
                out.pieces.append((p.get(1, b"").decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif number == 2:
                p = dict(_fields(value))
                out.kind, out.byte_fallback = p.get(3, UNIGRAM), bool(p.get(35, 0))
            elif number == 3:
                p = dict(_fields(value))
                out.charsmap = p.get(2, b"")
                out.dummy_prefix, out.trim_spaces, out.escape_spaces = (bool(p.get(n, 1)) for n in (3, 4, 5))
        return out

    @property
    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    def merges(self) -> list[tuple[str, str]]:
        """All ways to join two pieces to a third, best score of the third first."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        out = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                cuts = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in ids and piece[i:] in ids]
                out += [(-score, n, pair) for n, pair in enumerate(sorted(cuts, key=lambda c: (ids[c[0]], ids[c[1]])))]
        return [pair for _, _, pair in sorted(out, key=lambda x: x[:2])]

    def splits(self) -> bool:
        """Whether no piece reaches across a line end or from a letter to a following space.

        The stretches between are then merged each on its own, and equal ones
        need be encoded once.
        """
        text = [p for p, _, kind in self.pieces if kind in (NORMAL, USER, UNUSED)]
        across = any(re.search(f"[^{MARK}]{MARK}|\n.|.\n", p, re.S) for p in text)
        return self.kind == BPE and self.escape_spaces and not (across or self.charsmap or self.trim_spaces)

    def tokenizer(self, prefix: bool = True, typed: bool = True):
        """The model in the tokenizers library; without ``prefix`` no mark is set before a text.

        Under a unigram model, the names of control, byte and unused pieces
        would match where they are typed into a text.  Without ``typed`` they
        don't, and characters outside the model come as unknown tokens with
        their text; see ``Unigram``.
        """
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if self.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            made = Tokenizer(models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True,
                                        byte_fallback=self.byte_fallback))
        elif self.kind == UNIGRAM:
            least = min((s for _, s, kind in self.pieces if kind == NORMAL), default=0.0)
            named = [(p, s) if typed or kind in (NORMAL, USER) else (f"{HIDDEN}{i}", least) for i, (p, s, kind) in enumerate(self.pieces)]
            made = Tokenizer(models.Unigram(named, self.unknown, self.byte_fallback and typed))
        else:
            raise ValueError("only unigram and BPE models are supported")
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim_spaces:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix and prefix:
            steps.append(normalizers.Prepend(MARK if self.escape_spaces else " "))
        if self.escape_spaces:
            steps.append(normalizers.Replace(" ", MARK))
        made.normalizer = normalizers.Sequence(steps)
        back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        made.decoder = decoders.Sequence([*back, decoders.Strip(" ", 1, 0)] if self.dummy_prefix and prefix else back)
        return made


class Unigram:
    """Encodes with a unigram model; characters outside it become byte pieces if it has them."""

    def __init__(self, model: Model):
        self.made, self.unknown = model.tokenizer(typed=False), model.unknown
        places = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.bytes = [places.get(f"<0x{b:02X}>", model.unknown) for b in range(256)] if model.byte_fallback else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for e in self.made.encode_batch(texts, add_special_tokens=False):
            ids = e.ids
            if self.bytes and self.unknown in ids:
                ids = [i for n, t in zip(ids, e.tokens, strict=True) for i in ([self.bytes[b] for b in t.encode()] if n == self.unknown else [n])]
            out.append(ids)
        return out


class Codec:
    """Encodes and decodes batches with the rebuilt tokenizer, and holds it against the model's own library."""

    def __init__(self, data: bytes, threads: int = 1):
        import sentencepiece

        os.environ.update(TOKENIZERS_PARALLELISM="true", RAYON_NUM_THREADS=str(threads))
        self.model, self.threads = Model.parse(data), threads
        self.splits = self.model.splits()
        self.unigram = Unigram(self.model) if self.model.kind == UNIGRAM else None
        self.whole, self.bare = None, self.model.tokenizer(prefix=False) if self.splits else None
        self.own = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.memo = Memo(REMEMBERED)
        self.line = len(self.own.encode("\n"))

    def run(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids of each text, whether they decode to it, and whether the own library gives the same."""
        texts = [t or "" for t in texts]
        if not self.splits:
            return self._run(self._whole(), texts)
        ids, back, same, other = self._stretches(texts)
        odd = sorted({*other, *(i for i, t in enumerate(texts) if MARK in t)})  # marks can't be told from spaces
        if odd:
            some = [texts[i] for i in odd]
            for i, *got in zip(odd, *self._run(self._whole(), some), strict=True):
                ids[i], back[i], same[i] = got
        return ids, back, same

    def _whole(self):
        """The tokenizer for whole texts, made when a text needs it."""
        if self.whole is None:
            self.whole = self.model.tokenizer()
        return self.whole

    def _run(self, tokenizer, texts: list[str], given: list[str] | None = None, head: int = 0, tail: int = 0):
        """Ids and checks.  ``given`` is what the own library gets; its first ``head`` and last ``tail`` ids don't count."""
        got = self.unigram.encode(texts) if self.unigram else [
            e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = [i if t else [] for i, t in zip(got, texts, strict=True)]
        decoded = tokenizer.decode_batch(ids, skip_special_tokens=False)
        want = self.own.encode(texts if given is None else given, num_threads=self.threads)
        want = [w[head : len(w) - tail] for w in want]
        same = np.array([i == w for i, w in zip(ids, want, strict=True)], bool)
        return ([np.array(i, np.int32) for i in ids],
                np.array([a == b.replace(MARK, " ") for a, b in zip(decoded, texts, strict=True)], bool), same)

    def _stretches(self, texts: list[str]):
        """Ids and checks of each text, and the texts with a stretch that only its hash has in common with one in the memo."""
        lead = b" " if self.model.dummy_prefix else b""
        encoded = [lead + t.encode() if t else b"" for t in texts]
        sizes = np.fromiter((len(e) for e in encoded), np.int64, len(encoded))
        joined = b"".join(encoded)
        data = np.frombuffer(joined, np.uint8)
        begin = np.zeros(len(data), bool)
        begin[np.cumsum(sizes)[:-1][sizes[1:] > 0]] = True
        begin[:1] = True
        space, line = data == 32, data == 10
        begin[1:] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        start = np.flatnonzero(begin)
        stop = np.append(start[1:], len(data)) if len(start) else start
        hashes = range_hashes(data, start, stop)
        number = self._known(hashes, lambda n: joined[start[n] : stop[n]], space[start])
        same = same_ranges(data, start, stop, self.memo.data, self.memo.edge[number], self.memo.edge[number + 1])
        other = np.unique(np.searchsorted(np.cumsum(sizes), start[~same], "right")).tolist()
        first, size = self.memo.first[number], np.diff(self.memo.first)[number]
        ends = np.cumsum(size - 2)  # the first two values are the checks
        flat = self.memo.pool[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - first, size - 2)]
        edges = np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes))))
        at, fine = np.concatenate(([0], ends))[edges], []
        for k in (0, 1):
            bad = np.concatenate(([0], np.cumsum(self.memo.pool[first + k] == 0))) if len(size) else np.zeros(1, int)
            fine.append(bad[edges[1:]] == bad[edges[:-1]])
        return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], *fine, other

    def _known(self, hashes: np.ndarray, part, spaced: np.ndarray) -> np.ndarray:
        """Number of each stretch in the memo; new ones are encoded and checked first."""
        number = self.memo.find(hashes)
        kinds, where = np.unique(hashes[number < 0], return_index=True)
        where = np.flatnonzero(number < 0)[where]
        if not len(kinds):
            return number
        if self.memo.size + len(kinds) > self.memo.most:
            self.memo = Memo(self.memo.most)
            kinds, where = np.unique(hashes, return_index=True)
        values: list = [None] * len(kinds)
        for with_space in (True, False):
            every = np.flatnonzero(spaced[where] == with_space).tolist()
            for low in range(0, len(every), AT_ONCE):
                some = every[low : low + AT_ONCE]
                parts = [part(where[n]).decode() for n in some]
                # The own library sets a mark before a text: so one leading space less, or a line end before that doesn't count.
                if with_space and self.model.dummy_prefix:
                    got = self._run(self.bare, parts, [p[1:] + "\n" for p in parts], 0, self.line - 1)
                else:
                    got = self._run(self.bare, parts, ["\n" + p for p in parts], self.line)
                for n, ids, back, same in zip(some, *got, strict=True):
                    values[n] = np.array([back, same, *ids], np.int32)
        self.memo.add(kinds, [part(n) for n in where], values)
        return self.memo.find(hashes)


#: Bytes of text in a batch, and new stretches that are encoded at once.
BATCH, AT_ONCE = 4 << 20, 16_384


def load_model(path: str) -> bytes:
    """The bytes of a model file on the driver."""
    if os.path.getsize(path) > MOST_MODEL_BYTES:
        raise ValueError("the model is too large to send to all executors")
    with open(path, "rb") as f:
        return f.read()


def _threads(docs: DataFrame, threads: int | None) -> int:
    return threads or int(docs.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1"))


def encode_pieces(docs: DataFrame, model: bytes, text: str = "text", threads: int | None = None) -> DataFrame:
    """``docs`` with three columns more: ids, round_trip (they decode to the text, its marks read as spaces) and
    parity (the model's own library gives the same ids; it is a check only).

    The model file's pieces, scores, normaliser, space mark and byte fallback
    are rebuilt in the tokenizers library, whose batches run on ``threads``
    threads, as many as a task has cores (``spark.task.cpus``) if not given.  If no piece crosses a stretch (a word with its spaces, a line
    end), a batch's distinct stretches are encoded and checked once each.
    Input columns of the new names are replaced.

    NULL and empty texts have no ids and pass both checks; repeated rows give
    repeated results; no rows give no rows.
    """
    new = [StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType()), StructField("parity", BooleanType())]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.lit(0).alias("_")).alias("rest"),
                         F.col(text).alias("text"))
    schema = StructType([*packed.schema.fields, *new])
    arrow, sent = to_arrow_schema(schema), docs.sparkSession.sparkContext.broadcast(model)
    threads = _threads(docs, threads)

    def run(frames):
        codec = Codec(sent.value, threads)  # one a task, so that its memory doesn't outlive it
        for f in batches(frames, most=BATCH):
            ids, back, same = codec.run(texts_of(f))
            offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*f.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())),
                                              pa.array(back), pa.array(same)], schema=arrow)
        del codec
        give_back()

    names = [c for c in docs.columns if c not in ("ids", "round_trip", "parity")]
    return packed.mapInArrow(run, schema).select(
        *[F.col("text").alias(text) if c == text else F.col("rest").getField(c).alias(c) for c in names],
        "ids", "round_trip", "parity")


def decode_pieces(docs: DataFrame, model: bytes, ids: str = "ids", text: str = "text", threads: int | None = None) -> DataFrame:
    """``docs`` with the texts that a column of ids stands for, decoded in batches by the rebuilt tokenizer.

    Control pieces have no text; an unknown piece reads as its name.  NULL ids
    give NULL, no ids the empty text; an id outside the model, or NULL among
    ids, is an error.  An input column named like the new one is replaced.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns], F.lit(0).alias("_")).alias("rest")
    packed = docs.select(rest, F.col(f"`{ids}`").cast("array<int>").alias("ids"))
    schema = StructType([packed.schema["rest"], StructField("text", StringType())])
    arrow, sent = to_arrow_schema(schema), docs.sparkSession.sparkContext.broadcast(model)
    threads = _threads(docs, threads)

    def run(frames):
        os.environ.update(TOKENIZERS_PARALLELISM="true", RAYON_NUM_THREADS=str(threads))
        parsed = Model.parse(sent.value)
        made, silent = parsed.tokenizer(), {i for i, p in enumerate(parsed.pieces) if p[2] == CONTROL}
        for f in frames:
            rows = f.column("ids").to_pylist()
            if any(i is None or not 0 <= i < len(parsed.pieces) for row in rows for i in row or ()):
                raise ValueError("an id is not one of the model's")
            texts = made.decode_batch([[i for i in row or () if i not in silent] for row in rows], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([f.column("rest"), pa.array(
                [None if row is None else t for row, t in zip(rows, texts, strict=True)], pa.string())], schema=arrow)

    return packed.mapInArrow(run, schema).select(
        *[F.col("rest").getField(c).alias(c) for c in docs.columns if c != text], F.col("text").alias(text))


MODEL_PATH = os.environ.get("PACELINE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


@query("op10_sentencepiece")
def op10_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_pieces(docs, load_model(MODEL_PATH))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip", "parity")
