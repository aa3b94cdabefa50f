"""Words of many texts at once, as 64-bit hashes in flat arrays.

All texts of a batch lie in one byte buffer.  Words are hashed eight bytes at a
time, all words of the batch together; no Python code runs for a single word
but very long ones.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Words of more bytes are hashed one by one, by a digest.
LONG_WORD = 512
#: The low 0, 1, .. 8 bytes of 64 bits.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _lower(breaks: Callable[[int], bool]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.arange(256, dtype=np.uint8)
    codes[65:91] += 32
    return codes, np.array([breaks(int(c)) for c in codes])


#: Words between ASCII white space.
SPACED = _lower(lambda c: c == 32 or 9 <= c <= 13)
#: Words of ASCII letters and digits and everything beyond ASCII.
PLAIN = _lower(lambda c: c < 48 or 57 < c < 97 or 122 < c < 128)


class Words:
    """Where the words of some texts are.

    ``data``: lower-cased bytes of all texts, one separator after each;
    ``start``, ``stop``: byte range of each word; ``first``: for each text the
    index of its first word, and the number of all words at the end; ``offset``:
    first byte of each text in ``data``, and its length at the end.
    """

    def __init__(self, texts: Iterable[str | None], rule=SPACED):
        encoded = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        lengths = np.fromiter((len(t) + 1 for t in encoded), np.int64, len(encoded))
        self.offset = np.concatenate(([0], np.cumsum(lengths)))
        encoded.append(b"")
        self.raw = np.frombuffer(b" ".join(encoded), np.uint8)
        codes, breaks = rule
        self.data = codes[self.raw]
        inside = ~breaks[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.stop = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.offset)
        self.first[-1] = len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, salt: int = 0) -> np.ndarray:
        return range_hashes(self.data, self.start, self.stop, salt)


def _words_of_eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros behind the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _eight(eights: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    return eights[at] & _MASK[np.minimum(left, 8)]


def range_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range [start, stop).

    Ranges of one length up to eight bytes never collide.  Longer ones run
    eight bytes at a time through two chains of their own constants, very long
    ones through a digest; with ``salt`` all hashes are other ones.
    """
    size = stop - start
    eights = _words_of_eight(data)
    key = np.uint64((salt * 0x9E3779B97F4A7C15 + 0xD6E8FEB86659FD93) % (1 << 64))
    seed = mix(size.astype(np.uint64) ^ key)
    first = _eight(eights, start, size)
    out = mix(seed ^ first)
    order = np.flatnonzero(size > 8)
    order = order[np.argsort(-np.minimum(size[order], LONG_WORD + 1).astype(np.int16), kind="stable")]  # a radix sort
    n_long = int((size > LONG_WORD).sum())
    for i in order[:n_long].tolist():
        digest = hashlib.blake2b(data[start[i] : stop[i]], digest_size=8, salt=salt.to_bytes(16, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    order = order[n_long:]
    at, left = start[order], size[order]
    a, b = out[order], mix(first[order] + seed[order] * np.uint64(0xC2B2AE3D27D4EB4F))
    for k in range(8, int(left[0]) if len(left) else 0, 8):
        m = int(np.searchsorted(-left, -k))
        piece = _eight(eights, at[:m] + k, left[:m] - k)
        a[:m] = mix(a[:m] ^ piece)
        b[:m] = mix(b[:m] * np.uint64(0xC2B2AE3D27D4EB4F) + (piece >> np.uint64(29) | piece << np.uint64(35)))
    out[order] = mix(a ^ (b >> np.uint64(31) | b << np.uint64(33)))
    return out


def same_ranges(data: np.ndarray, start: np.ndarray, stop: np.ndarray, other: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each range of ``data`` holds the same bytes as the range of ``other`` beside it."""
    size = stop - start
    same = size == end - begin
    one, two = _words_of_eight(data), _words_of_eight(other)
    long = same & (size > LONG_WORD)
    for i in np.flatnonzero(long).tolist():
        same[i] = np.array_equal(data[start[i] : stop[i]], other[begin[i] : end[i]])
    short = np.flatnonzero(same & ~long)
    at, to, left = start[short], begin[short], size[short]
    while len(short):
        differs = _eight(one, at, left) != _eight(two, to, left)
        same[short[differs]] = False
        on = ~differs & (left > 8)
        short, at, to, left = short[on], at[on] + 8, to[on] + 8, left[on] - 8
    return same


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; a shorter text is one shingle, an empty one has none."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= words[k : len(words) - n + 1 + k]
        out = mix(out)
    return out


def give_back() -> None:
    """Return free memory to the system: a worker lives on for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def batches(frames: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that one holds few texts beyond ``most`` bytes; a longer text comes alone."""
    for frame in frames:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(frame.column(text)), 0))
        ends = np.cumsum(sizes)
        i = 0
        while i < frame.num_rows:
            j = max(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")), i + 1)
            yield frame.slice(i, j - i)
            i = j
    give_back()


def texts_of(frame: pa.RecordBatch, text: str = "text") -> list:
    return frame.column(text).to_pylist()


def frame_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type, from_pandas=isinstance(c, pd.Series))
        for n, c in columns.items()], schema=schema)
