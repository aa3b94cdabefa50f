"""Text expressions: folding, tokens, set similarity, trigram word similarity.

Every function takes and returns Columns, so the work stays in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceline import fixed_values as V

# Blank characters: Java's \s and trim() miss the non-breaking and wide ones.
BLANKS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WS = f"[{BLANKS}]"
BLANK_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
NOT_WS = f"[^{BLANKS}]"
# Word characters as classes that are looked up: without regard to case, ranges are folded for every character tested.
# Four characters outside ASCII fold to an ASCII letter, and so count as one then.
_WORD, _WORD_ANY_CASE = r"\w", r"[\w\u0130\u0131\u017F\u212A]"
_EDGE, _EDGE_ANY_CASE = (f"(?:(?<!{w})(?={w})|(?<={w})(?!{w}))" for w in (_WORD, _WORD_ANY_CASE))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column used several times in one expression is copied into the tree at
    each use; steps built on steps would grow it exponentially.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pattern(text: str, ignore_case: bool = False) -> str:
    r"""Spell out ``\b`` (ASCII) and ``\s`` (all blanks) of a fixed pattern."""
    text = text.replace(r"\b", _EDGE_ANY_CASE if ignore_case else _EDGE).replace(r"\s", WS)
    return f"(?iu){text}" if ignore_case else text


def like(col: Column, text: str, ignore_case: bool = True) -> Column:
    return col.rlike(pattern(text, ignore_case))


def _branches(words: list[str]) -> str:
    """One pattern for any of the words, with common beginnings once; the longest match need not come first."""
    heads: dict[str, list[str]] = {}
    for word in words:
        heads.setdefault(word[:1], []).append(word[1:])
    arms = [re.escape(head) + (_branches(rests) if any(rests) else "") for head, rests in heads.items() if head]
    return (arms[0] if len(arms) == 1 and "" not in heads else f"(?:{'|'.join(arms)})") + ("?" if "" in heads else "")


def _as_words(text: str) -> str:
    r"""``\b(?:one|two)\b`` for texts without capitals, quick to test; other patterns as they are.

    An edge next to an ASCII word character is a missing neighbour of that kind,
    and next to another character it is a neighbour of that kind.
    """
    plain = re.fullmatch(r"\\b(?:(\w+)|\(\?:([\w ]+(?:\|[\w ]+)*)\))\\b", text)
    if not plain:
        return text
    alike: dict[tuple[str, str], list[str]] = {}
    for word in (plain[1] or plain[2]).split("|"):
        before, after = (re.match(r"\w", c, re.ASCII) for c in (word[0], word[-1]))
        alike.setdefault((r"(?<!\w)" if before else r"(?<=\w)", r"(?!\w)" if after else r"(?=\w)"), []).append(word)
    return "|".join(before + _branches(words) + after for (before, after), words in alike.items())


def like_folded(normalized: Column, text: str) -> Column:
    """``like`` for folded text: plain ASCII, where the engine's own word edge will do."""
    return normalized.rlike(_as_words(text))


@lru_cache(maxsize=1)
def _capitals() -> tuple[str, str]:
    """Characters that a pattern's letter meets without regard to case, and that letter."""
    meets = {c: chr(c).upper().lower() for c in range(0x80, 0x250) if len(chr(c).upper()) == 1} | {0x130: "i", 0x212A: "k"}
    meets |= {c: chr(c).lower() for c in range(ord("A"), ord("Z") + 1)}
    found = [(chr(c), low) for c, low in meets.items() if low != chr(c) and len(low) == 1]
    return "".join(c for c, _ in found), "".join(low for _, low in found)


def small_letters(col: Column) -> Column:
    """Text on which patterns find with regard to case what they find without on ``col``, letter by letter."""
    return F.translate(col, *_capitals())


def like_small(small: Column, text: str) -> Column:
    """``like`` for text of small letters (see ``small_letters``) and patterns written in them."""
    words = _as_words(text)
    return small.rlike(pattern(text) if words == text else words)


def replace_first(col: Column, text: str, by: str) -> Column:
    """Replace only the leftmost match; groups of ``text`` start at ``$2``."""
    return F.regexp_replace(col, f"(?s)^(.*?)(?:{pattern(text)})", "$1" + by)


def drop_first_folded(normalized: Column, text: str) -> Column:
    """Blank out the leftmost match in folded text."""
    return F.regexp_replace(normalized, f"^(.*?)(?:{text})", "$1 ")


def trim_blanks(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANK_CHARS))


def drop_blanks(col: Column) -> Column:
    return F.translate(col, BLANK_CHARS, "")


def is_blank(col: Column) -> Column:
    """True for NULL and for text made of blanks only."""
    return F.coalesce(trim_blanks(col) == "", F.lit(True))


def null_if_empty(col: Column) -> Column:
    return F.when(col != "", col)


@lru_cache(maxsize=1)
def _fold_map() -> tuple[str, str, str]:
    """Characters whose canonical decomposition is one ASCII letter plus marks,
    the letters they fold to, and the marks to drop."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFD", char) if not "\u0300" <= c <= "\u036f")
        if plain != char and len(plain) == 1 and plain.isascii():
            source.append(char)
            target.append(plain)
    return "".join(source), "".join(target), "".join(map(chr, range(0x300, 0x370)))


def normalize_text(col: Column) -> Column:
    """Fold accents, lower-case, and reduce everything else to single spaces."""
    source, target, marks = _fold_map()
    plain = F.translate(col, source + marks, target)  # what has no counterpart is dropped
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))


def normalize_czech(col: Column) -> Column:
    """Fold a fixed alphabet and lower-case; punctuation stays, NULL stays NULL."""
    return F.lower(F.translate(col, V.CZECH_FROM, V.CZECH_TO))


def token_list(normalized: Column, min_chars: int = 2) -> Column:
    """Words of already normalised text, repeats kept."""
    return F.filter(F.split(normalized, " "), lambda w: F.length(w) >= min_chars)


def token_set(normalized: Column) -> Column:
    """Distinct words longer than one character."""
    return F.array_distinct(token_list(normalized))


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two token arrays; two empty sets are equal."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(F.array_union(a, b))
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / F.greatest(total, F.lit(1)))


def tokens_overlap(a: Column, b: Column) -> Column:
    """Any shared token; an empty side puts no constraint."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def has_word(normalized: Column, word: Column) -> Column:
    """Whole-word match inside normalised text."""
    return F.array_contains(F.split(normalized, " "), word)


def trigrams(col: Column) -> Column:
    """Ordered trigrams of each word, padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def of_word(word):
        return let(F.concat(F.lit("  "), word, F.lit(" ")), pieces)

    def pieces(padded):
        starts = F.sequence(F.lit(1), F.length(padded) - 2)
        return F.transform(starts, lambda i: padded.substr(i, F.lit(3)))

    return F.flatten(F.transform(words, of_word))


def word_similarity(query: Column, text: Column) -> Column:
    """Best similarity of the query's trigram set with any run of the text's trigrams.

    A best run starts and ends at a trigram of the query, so only those
    positions are tried.  The sets' sizes follow from the positions: each counts
    once, but for those that repeat a trigram of the same run.  The result is
    single precision, as thresholds expect.
    """
    def score(wanted, grams):
        places = F.filter(
            F.transform(grams, lambda g, i: F.when(F.array_contains(wanted, g), i + 1)), lambda i: i.isNotNull()
        )

        def again(g, i):
            """A trigram that was there before: its position, the last one before it, and whether the query has it."""
            last = i - F.array_position(F.reverse(F.slice(grams, 1, i)), g) + 1
            return F.when(F.array_position(grams, g) <= i, F.struct(
                (i + 1).alias("at"), last.alias("last"), F.array_contains(wanted, g).cast("int").alias("wanted")))

        repeats = F.when(F.size(grams) > F.size(F.array_distinct(grams)), F.filter(F.transform(grams, again), lambda r: r.isNotNull()))

        def of_run(start, end, met, twice):
            def of_sizes(size, shared):
                return shared / (F.size(wanted) + size - shared)

            def less(inner):
                return of_sizes(end - start + 1 - F.size(inner), met - F.size(F.filter(inner, lambda r: r["wanted"] == 1)))

            inside = F.filter(twice, lambda r: (r["at"] <= end) & (r["last"] >= start))
            return F.when(twice.isNull(), of_sizes(end - start + 1, met)).otherwise(let(inside, less))

        def best_from(places, start, nth, twice):
            ends = F.slice(places, nth + 1, F.size(places))
            return F.array_max(F.transform(ends, lambda e, more: of_run(start, e, more + 1, twice)))

        def best_of(places, twice):
            return F.array_max(F.transform(places, lambda s, nth: best_from(places, s, nth, twice)))

        return let(places, lambda p: let(repeats, lambda t: best_of(p, t)))

    best = let(F.array_distinct(trigrams(query)), lambda w: let(trigrams(text), lambda g: score(w, g)))
    single = F.coalesce(best, F.lit(0.0)).cast("float").cast("double")
    return F.when(query.isNotNull() & text.isNotNull(), single)


def may_be_similar(query: Column, text: Column, least: float) -> Column:
    """False only where ``word_similarity`` can't be above ``least``.

    No run scores more than the share of the query's trigrams that the whole
    text has; that is one set operation instead of a look at every run.
    """
    def enough(wanted):
        return F.size(F.array_intersect(wanted, trigrams(text))) >= F.size(wanted) * least - 1e-6

    return F.coalesce(let(F.array_distinct(trigrams(query)), enough), F.lit(False))
