"""Benchmark decontamination: a suffix automaton of all test items tracks how long training texts match them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from paceline.llm.common import Staged, keeping, query, table
from paceline.llm.lookup import Lookup
from paceline.llm.words import PLAIN, Words, batches, range_hashes, same_ranges, texts_of

WINDOW = 10
#: Words of test items in one automaton (some 150 MB); more items take further passes over the texts.
AUTOMATON_WORDS = 200_000


class Automaton:
    """Generalised suffix automaton over word numbers.

    ``step`` follows one word and says how long a run of words ending there
    occurs in some item.  ``ended`` names the windows that end there.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        number = {w: n for n, w in enumerate(sorted({w for _, words in items for w in words}))}
        self.data = np.frombuffer(b"".join(number), np.uint8)
        self.stop = np.cumsum([len(w) for w in number], dtype=np.int64)
        self.start = np.concatenate(([0], self.stop[:-1])).astype(np.int64)[: len(self.stop)]
        hashes, self.salt = range_hashes(self.data, self.start, self.stop), 0
        while len(np.unique(hashes)) < len(hashes):
            self.salt += 1
            hashes = range_hashes(self.data, self.start, self.stop, self.salt)
        self.vocabulary = Lookup(hashes)
        self.next, self.link, self.length = [{}], [-1], [0]
        coded = [(i, [number[w] for w in words]) for i, words in items]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.shortest = min((min(window, len(c)) for _, c in coded), default=window)
        #: For a state that ends a window: its length and the items it is from.
        self.windows: dict[int, dict[int, set[str]]] = {}
        self.above: dict[int, list] = {}
        for item, codes in coded:
            size, state, run = min(window, len(codes)), 0, 0
            for c in codes:
                state, run = self.step(state, run, c)
                if run >= size:
                    self.windows.setdefault(self._holder(state, size), {}).setdefault(size, set()).add(item)

    def numbers(self, words: Words) -> np.ndarray:
        """The number of each word, -1 if no item has it: found by hash, then compared byte by byte."""
        codes = self.vocabulary.find(words.hashes(self.salt))
        known = np.flatnonzero(codes >= 0)
        to = codes[known]
        same = same_ranges(words.data, words.start[known], words.stop[known], self.data, self.start[to], self.stop[to])
        codes[known[~same]] = -1
        return codes

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            return self._split(last, c)
        new = self._state({}, -1, length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        link[new] = 0 if p < 0 else self._split(p, c)
        return new

    def _split(self, p: int, c: int) -> int:
        """The state reached from p by c, cut off so that it holds nothing longer."""
        nxt, link, length = self.next, self.link, self.length
        q = nxt[p][c]
        if length[q] == length[p] + 1:
            return q
        copy = self._state(dict(nxt[q]), link[q], length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def _state(self, nxt: dict, link: int, length: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def step(self, state: int, run: int, c: int) -> tuple[int, int]:
        nxt = self.next
        while state and c not in nxt[state]:
            state = self.link[state]
            run = self.length[state]
        if c in nxt[state]:
            return nxt[state][c], run + 1
        return 0, 0

    def _holder(self, state: int, size: int) -> int:
        """The state on the way to the root that holds the last ``size`` words."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def ended(self, state: int, run: int) -> list[tuple[int, frozenset]]:
        """(size, items) of the windows that end at a match of ``run`` words."""
        if state not in self.above:
            own, s = [], state
            while s > 0:
                own += [(size, frozenset(items)) for size, items in self.windows.get(s, {}).items()]
                s = self.link[s]
            self.above[state] = own
        return [x for x in self.above[state] if x[0] <= run]

    def scan(self, codes: np.ndarray, first: np.ndarray) -> dict[int, tuple[np.ndarray, set[str]]]:
        """Texts with hits: a mark for each word, and the items found."""
        found: dict = {}
        known = codes >= 0
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        # Only runs of words that items know, inside one text and as long as the shortest window, need the automaton.
        cut = np.flatnonzero((known[1:] != known[:-1]) | (text[1:] != text[:-1])) + 1
        begins, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(codes)]))
        if not len(codes):
            return found
        worth = known[begins] & (ends - begins >= self.shortest)
        for b, e in zip(begins[worth].tolist(), ends[worth].tolist(), strict=True):
            state = run = 0
            t = int(text[b])
            for i, c in enumerate(codes[b:e].tolist(), b):
                state, run = self.step(state, run, c)
                if run < self.shortest:
                    continue
                for size, items in self.ended(state, run):
                    if t not in found:
                        found[t] = (np.zeros(first[t + 1] - first[t], bool), set())
                    at = i - int(first[t])
                    found[t][0][at - size + 1 : at + 1] = True
                    found[t][1].update(items)
        return found


def _chunks(items: DataFrame, most: int, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Test items with their words, in lists of at most ``most`` words; a longer item comes in stretches that share all but one
    word of a window, so that each of its windows is whole in one of them."""
    held, size, most = [], 0, max(most, window)
    for row in items.toLocalIterator():
        found = Words([row[1]], PLAIN)
        data, name = found.data.tobytes(), "" if row[0] is None else row[0]
        words = [data[b:e] for b, e in zip(found.start.tolist(), found.stop.tolist(), strict=True)]
        for low in range(0, max(len(words) - window + 1, min(len(words), 1)), most - window + 1):
            part = words[low : low + most]
            if held and size + len(part) > most:
                yield held
                held, size = [], 0
            held.append((name, part))
            size += len(part)
    yield held


FOUND = [StructField("n_words", LongType()), StructField("marks", ArrayType(IntegerType())),
         StructField("items", ArrayType(StringType()))]


def _runs(marks: np.ndarray) -> np.ndarray:
    """[begin, end) pairs of the runs of true marks, flat."""
    padded = np.concatenate(([False], marks, [False]))
    return np.flatnonzero(padded[1:] != padded[:-1])


def _pass(automaton, schema: pa.Schema, then=None):
    """Marks and items of a chunk added to each row; ``then`` takes the batches on in the same worker."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return marked(frames) if then is None else then(marked(frames))

    def marked(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Automaton = automaton.value
        for frame in batches(frames):
            words = Words(texts_of(frame), PLAIN)
            found = a.scan(a.numbers(words), words.first)
            marks, items = frame.column("marks").to_pylist(), frame.column("items").to_pylist()
            for t, (mark, names) in found.items():
                for b, e in zip(marks[t][::2], marks[t][1::2], strict=True):
                    mark[b:e] = True
                marks[t], items[t] = _runs(mark).tolist(), sorted({*items[t], *names})
            columns = [frame.column(n) for n in schema.names[:-3]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(words.counts, pa.int64()), pa.array(marks, pa.list_(pa.int32())),
                 pa.array(items, pa.list_(pa.string()))], schema=schema)

    return run


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str | list[str] = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
               automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """What each text shares with test items.

    Words are lower-cased runs of letters, digits and characters beyond ASCII.
    A window is ``window`` consecutive words of an item, or the whole of a
    shorter one.  Returns one row per input row: the id columns, text, n_words,
    marks (flat [begin, end) word ranges covered by occurring windows) and
    items (ids, as strings, of items with an occurring window).

    Items are read in chunks of at most ``automaton_words`` words, long items
    cut with an overlap; only one chunk's automaton is on the driver or in a
    worker at a time, whatever the number and length of items, and every chunk
    sees every text.  Words are looked up by hash and compared in full.

    NULL and empty texts have no words; NULL or empty items none to find; a
    NULL item id counts as the empty string; repeated items count once; no
    documents give no rows, no items no hits.
    """
    return _leaks(docs, items, doc_id, text, item_id, item_text, window, automaton_words)


def _leaks(docs: DataFrame, items: DataFrame, doc_id: str | list[str], text: str, item_id: str = "item_id", item_text: str = "text",
           window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS, then=None, returns: StructType | None = None) -> DataFrame:
    """``find_leaks``, or what ``then`` makes of its batches: the last pass hands them on, without a second worker for each task."""
    ids = [doc_id] if isinstance(doc_id, str) else doc_id
    rows = keeping(docs, {**{c: F.col(c) for c in ids}, "text": F.col(text)})
    rows = rows.withColumns({"n_words": F.lit(0).cast("long"), "marks": F.array().cast("array<int>"),
                             "items": F.array().cast("array<string>")})
    schema = StructType([*rows.schema.fields[:-3], *FOUND])
    arrow = to_arrow_schema(schema)
    wanted = items.select(F.col(item_id).cast("string"), F.col(item_text))
    staged, spark = Staged(docs.sparkSession, "leaks"), docs.sparkSession
    chunks = _chunks(wanted, automaton_words, window)
    chunk, n = next(chunks), 0
    while chunk is not None:
        if n:  # the pass before ends first, so that two automata never share a worker
            rows = staged.put(f"pass{n}", rows)
        automaton, chunk, n = spark.sparkContext.broadcast(Automaton(chunk, window)), next(chunks, None), n + 1
        last = chunk is None and then is not None
        rows = rows.mapInArrow(_pass(automaton, arrow, then if last else None), returns if last else schema)
    return rows


def _cut(schema: pa.Schema, max_words: int, max_cover: float):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts, keep = frame.column("text").to_pylist(), np.ones(frame.num_rows, bool)
            for t, marks in enumerate(frame.column("marks").to_pylist()):
                if not marks:
                    continue
                pairs = [(b, e) for b, e in zip(marks[::2], marks[1::2], strict=True) if e - b >= max_words]
                words = Words([texts[t]], PLAIN)
                if sum(e - b for b, e in pairs) > max_cover * len(words.start):
                    keep[t] = False
                    continue
                raw, at, parts = words.raw[:-1].tobytes(), 0, []
                for b, e in pairs:
                    parts.append(raw[at : words.start[b]])
                    at = words.stop[e - 1]
                texts[t] = b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")
            columns = [frame.column(n) for n in schema.names[:-1]]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], schema=schema)
            yield out.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW,
                  max_words: int = WINDOW, max_cover: float = 0.5, **names) -> DataFrame:
    """``docs`` without what they share with test items.

    A shared span of ``max_words`` words or more is cut out of its text; a
    document of which more than ``max_cover`` is such spans goes as a whole.
    Spans of fewer than ``window`` words are whole items that short: with
    ``max_words=1`` they are cut and count as the others do.
    Other documents stay as they are, with all their columns.
    """
    rest = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_")).alias("rest"), F.col(text).alias("text"))
    schema = StructType([packed.schema["rest"], packed.schema["text"]])
    kept = _leaks(packed, items, ["rest"], "text", window=window, then=_cut(to_arrow_schema(schema), max_words, max_cover), returns=schema, **names)
    return kept.select(*[F.col("text").alias(text) if c == text else F.col("rest").getField(c).alias(c) for c in docs.columns])


def leak_report(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """n_words, n_hit, n_items, digest of the items, contaminated."""
    ends: Column = F.aggregate(
        F.transform("marks", lambda m, i: F.when(i % 2 == 1, m).otherwise(-m).cast("long")), F.lit(0).cast("long"), lambda a, m: a + m)
    return found.select(
        F.col(doc_id), "n_words", ends.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("marks") > 0).alias("contaminated"))


LEAKS_SQL = rf"""
WITH iw AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, len(part) AS n, array_to_string(part, ' ') AS words FROM (
       SELECT item, w[unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) :][:least(len(w), {WINDOW})] AS part
       FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT row, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM dw, sizes WHERE len(w) >= n),
hit AS (SELECT row, i, a.n, item FROM (SELECT row, n, i, array_to_string(w[i : i + n - 1], ' ') AS words FROM places) a
        JOIN win ON a.n = win.n AND a.words = win.words),
per AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM hit) GROUP BY row),
names AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT row, item FROM hit) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN per USING (row) LEFT JOIN names USING (row)"""


@query("op5_decontamination", LEAKS_SQL)
def op5_decontamination(spark, sf_dir):
    return leak_report(find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
