"""Scanline bitmaps: a scanline is as many words as it needs, bit x of word k is pixel ``k * WORD + x``.

Union, area and difference are single instructions on a word, and words meet by equality of (sample, line, word). Words without a
pixel are not stored. A relation without the column ``k`` has one word a scanline: canvases of at most ``WORD`` pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels of a word: seven bytes, so that the sign bit is never set and sums of two words don't pass it.
WORD = 56
#: What words of a sample meet by.
LINE = ["sample_id", "y", "k"]


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with its word numbers; without them every row is word 0."""
    return df if "k" in df.columns else df.withColumn("k", F.lit(0))


def zero() -> Column:
    return F.lit(0).cast("long")


def run(x1: Column, x2: Column) -> Column:
    """Pixels from x1 up to x2 of a word, x2 not included."""
    return F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), (x2 - x1).cast("int")) - 1, x1.cast("int"))


def full(width: Column | int, k: Column | None = None) -> Column:
    """All pixels of word ``k`` of a scanline of ``width``; of the only word if there is no number."""
    w = F.lit(width) if isinstance(width, int) else width
    if k is not None:
        w = F.greatest(F.lit(0), F.least(F.lit(WORD), w - k * WORD))
    return F.call_function("shiftleft", F.lit(1).cast("long"), w.cast("int")) - 1


def n_words(width: int) -> int:
    return -(-width // WORD)


def numbers(width: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n_words(width) - 1))


def words(x1: Column, x2: Column) -> Column:
    """The run from x1 up to x2 as an array of (k, bits); x2 not included, x1 < x2."""
    ks = F.sequence(F.floor(x1 / WORD).cast("int"), F.floor((x2 - 1) / WORD).cast("int"))
    return F.transform(ks, lambda k: F.struct(k.alias("k"), run(F.greatest(x1 - k * WORD, F.lit(0)), F.least(x2 - k * WORD, F.lit(WORD))).alias("bits")))


def spread(df: DataFrame, x1: Column, x2: Column, *keep: str) -> DataFrame:
    """(keep, k, bits): one row a word of each row's run."""
    return df.select(*keep, F.explode(words(x1, x2)).alias("w")).select(*keep, "w.k", "w.bits")


def at(bits: Column, x: Column) -> Column:
    """0 or 1 at pixel x of a word."""
    return F.call_function("shiftright", bits, x.cast("int")).bitwiseAND(F.lit(1).cast("long"))


def without(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def area(bits: Column) -> Column:
    return F.bit_count(bits)


def first(bits: Column) -> Column:
    """Smallest pixel set; null for none."""
    return F.when(bits != 0, F.bit_count(bits.bitwiseAND(-bits) - 1))


def last(bits: Column) -> Column:
    """Largest pixel set; null for none."""
    return F.when(bits != 0, F.length(F.bin(bits)) - 1)


def runs(bits: Column) -> Column:
    """An array of (a, b), both included: the stretches of set pixels of a word. Most words have one, which is found without a loop."""
    low = bits.bitwiseAND(-bits)
    one = F.array(F.struct(F.bit_count(low - 1).alias("a"), (F.bit_count(low - 1) + F.bit_count(bits) - 1).alias("b")))
    start = lambda i: (at(bits, i) == 1) & ((i == 0) | (F.call_function("shiftright", bits, F.greatest(i - 1, F.lit(0))).bitwiseAND(F.lit(1).cast("long")) == 0))

    def stretch(i: Column) -> Column:
        rest = F.call_function("shiftright", bits, i)
        # The lowest clear pixel of what is left ends the stretch.
        return F.struct(i.alias("a"), (i + F.bit_count(F.bitwise_not(rest).bitwiseAND(rest + 1) - 1) - 1).alias("b"))

    many = F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), start), stretch)
    return F.when((bits + low).bitwiseAND(bits) == 0, one).otherwise(many)


def where(n: int, flag) -> Column:
    """A word whose pixel x is set where ``flag(x)`` holds, x a column from 0 to ``n - 1``."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), zero(), lambda acc, x: acc.bitwiseOR(F.when(flag(x), F.call_function("shiftleft", F.lit(1).cast("long"), x)).otherwise(zero())))


def lines(df: DataFrame, bits: str, *by: str) -> DataFrame:
    """(by, bits): one row a scanline, its words as a map from their number."""
    return keyed(df).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", bits))).alias(bits))


def pixel(words: Column, x: Column) -> Column:
    """Whether pixel x is set in a scanline of :func:`lines`."""
    word = F.coalesce(F.element_at(words, F.floor(x / WORD).cast("int")), zero())
    return at(word, F.pmod(x, F.lit(WORD))) == 1
