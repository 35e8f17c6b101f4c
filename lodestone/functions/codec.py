"""Text forms of features, in expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_bits(vector: Column, dims: int = 64) -> Column:
    """A bitmap of 64-bit blocks: bit i is set where component i is positive."""
    bits = lambda lo: F.aggregate(F.sequence(F.lit(0), F.lit(min(64, dims - lo) - 1)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.when(F.element_at(vector, i + lo + 1) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    return F.array(*[bits(lo) for lo in range(0, dims, 64)])


def blocks_to_hex(blocks: Column) -> Column:
    """16 hexadecimal digits a block, in two's complement."""
    return F.array_join(F.transform(blocks, lambda b: F.lpad(F.lower(F.hex(b)), 16, "0")), "")


def hex_to_blocks(text: Column, n: int) -> Column:
    """Null unless the text is exactly n blocks of hexadecimal digits."""
    parts = F.array(*[F.conv(F.substring(text, 16 * i + 1, 16), 16, -10).cast("long") for i in range(n)])
    return F.when(text.rlike(f"^[0-9a-fA-F]{{{16 * n}}}$"), parts)


def words_to_hex(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.lower(F.hex(w))), " ")


def hex_to_words(text: Column, idf: Column | None = None) -> Column:
    """Sorted distinct words; those whose weight in the map ``idf`` is 0 or missing are dropped."""
    parts = F.filter(F.split(F.trim(text), "\\s+"), lambda s: s != "")
    words = F.array_sort(F.array_distinct(F.transform(parts, lambda s: F.conv(s, 16, 10).cast("long"))))
    if idf is None:
        return words
    # a map is searched from end to end for each key, and made anew for each word inside a lambda: its keys are met as a set
    own = F.map_keys(F.map_filter(idf, lambda _, w: F.coalesce(w, F.lit(0.0)) > 0)).cast("array<bigint>")
    return F.array_intersect(words, F.coalesce(own, F.array().cast("array<bigint>")))


def _scientific(x: Column) -> Column:
    # %e rounds the shortest decimal that names x, and halves up; this rounds x itself, and halves to even. Whole numbers
    # go in as such, since of a double the formatter doesn't know that it is exactly between two.
    x = x.cast("double")
    digits = lambda n: F.call_function("format_number", n, F.lit("0.000000E00"))
    whole = (x == F.rint(x)) & (F.abs(x) >= 1e7) & (F.abs(x) < float(1 << 63))
    text = F.when(whole, digits(x.cast("long"))).otherwise(digits(x))
    text = F.replace(F.replace(F.replace(text, F.lit("E-"), F.lit("e-")), F.lit("E"), F.lit("e+")), F.lit("∞"), F.lit("inf"))
    return F.when(x.isNull(), "null").when(F.isnan(x), "nan").otherwise(text)


def floats_to_text(v: Column) -> Column:
    """Seven digits and an exponent each, rounded exactly; only doubles below 2.3e-308 are rounded from their shortest form."""
    return F.array_join(F.transform(v, _scientific), " ")


def text_to_floats(text: Column, n: int | None = None) -> Column:
    """Null where a part isn't a number, or where there aren't n of them."""
    parts = F.transform(F.filter(F.split(F.trim(text), "\\s+"), lambda s: s != ""), lambda s: F.try_to_number_double(s) if hasattr(F, "try_to_number_double") else s.try_cast("double"))
    ok = F.forall(parts, lambda x: x.isNotNull())
    return F.when(ok if n is None else ok & (F.size(parts) == n), parts)


def block_words(block: Column, bits: Column) -> Column:
    """The words of one 64-bit block of a bitmap."""
    held = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", bits, i).bitwiseAND(F.lit(1).cast("long")) == 1)
    return F.transform(held, lambda i: block * 64 + i)
