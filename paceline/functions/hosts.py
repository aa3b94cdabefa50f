"""Host names in ASCII: the published Bootstring encoding of labels, as folds over their characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceline.functions.text import let

# Fixed values of the published encoding.
BASE, LEAST, MOST, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Digits that any difference of a label of a host can need.
PLACES = 8


def _digit(value: Column) -> Column:
    return F.substr(F.lit(DIGITS), (value + 1).cast("int"), F.lit(1))


def _number(delta: Column, bias: Column) -> Column:
    """A difference in digits whose weights depend on the bias, the lowest first."""
    def step(state, place):
        def grown(least):
            rest = state["left"] - least
            more = F.struct(
                F.concat(state["text"], _digit(least + rest % (BASE - least))).alias("text"), F.floor(rest / (BASE - least)).alias("left"),
                F.lit(False).alias("done"))
            last = F.struct(F.concat(state["text"], _digit(state["left"])).alias("text"), state["left"].alias("left"), F.lit(True).alias("done"))
            return F.when(state["left"] < least, last).otherwise(more)

        least = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), place * BASE - bias)).cast("bigint")
        return F.when(state["done"], state).otherwise(let(least, grown))

    start = F.struct(F.lit("").alias("text"), delta.cast("bigint").alias("left"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(PLACES)), start, step, lambda s: s["text"])


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a difference."""
    def settled(d):
        start = F.struct(d.alias("d"), F.lit(0).cast("bigint").alias("k"))
        halved = F.aggregate(F.sequence(F.lit(1), F.lit(PLACES)), start, lambda s, _: F.when(
            s["d"] > (BASE - LEAST) * MOST // 2, F.struct(F.floor(s["d"] / (BASE - LEAST)).alias("d"), (s["k"] + BASE).alias("k"))).otherwise(s))
        return let(halved, lambda s: s["k"] + F.floor((BASE - LEAST + 1) * s["d"] / (s["d"] + SKEW)))

    scaled = F.floor(delta / F.when(first, DAMP).otherwise(2))
    return let(let(scaled, lambda d: d + F.floor(d / points)), settled)


def _encoded(codes: Column) -> Column:
    """A label given by its code points, some of them beyond ASCII."""
    plain = F.filter(codes, lambda c: c < FIRST_CODE)

    def with_basic(basic):
        def emit(state, code):
            number = _number(state["delta"], state["bias"])
            written = F.struct(
                F.lit(0).cast("bigint").alias("delta"), _adapted(state["delta"], state["done"] + 1, state["done"] == F.size(basic)).alias("bias"),
                (state["done"] + 1).alias("done"), F.concat(state["text"], number).alias("text"))
            passed = F.struct((state["delta"] + 1).alias("delta"), state["bias"].alias("bias"), state["done"].alias("done"), state["text"].alias("text"))
            return lambda c: F.when(c == code, written).when(c < code, passed).otherwise(state)

        def of_code(state, code):
            jumped = F.struct(
                (state["delta"] + (code - state["code"]) * (state["done"] + 1)).alias("delta"), state["bias"].alias("bias"),
                state["done"].alias("done"), state["text"].alias("text"))
            inner = F.aggregate(codes, jumped, lambda s, c: emit(s, code)(c))
            return let(inner, lambda s: F.struct(
                (code + 1).alias("code"), (s["delta"] + 1).alias("delta"), s["bias"].alias("bias"), s["done"].alias("done"), s["text"].alias("text")))

        text = F.array_join(F.transform(basic, lambda c: F.char(c)), "")
        start = F.struct(
            F.lit(FIRST_CODE).cast("bigint").alias("code"), F.lit(0).cast("bigint").alias("delta"), F.lit(FIRST_BIAS).cast("bigint").alias("bias"),
            F.size(basic).cast("bigint").alias("done"), F.when(F.size(basic) > 0, F.concat(text, F.lit("-"))).otherwise("").alias("text"))
        others = F.array_sort(F.array_distinct(F.filter(codes, lambda c: c >= FIRST_CODE)))
        return F.aggregate(others, start, of_code, lambda s: s["text"])

    return let(plain, with_basic)


def ascii_host(host: Column) -> Column:
    """``host`` with its labels beyond ASCII lower-cased and encoded; others stay as they are.

    Characters are taken as they come: composed and decomposed letters are
    different ones.
    """
    def label(part):
        low = F.lower(part)
        codes = F.transform(F.sequence(F.lit(1), F.char_length(low)), lambda i: F.ascii(F.substr(low, i, F.lit(1))).cast("bigint"))
        return F.when(part.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("xn--"), let(codes, _encoded))).otherwise(part)

    return F.when(host.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(host, r"\.", -1), label), ".")).otherwise(host)
