"""Similarities and the vector algebra under them. Each takes and returns columns; search and pairwise calls share them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the four levels of a spatial pyramid, and how many of its 16 cells lie at or before each level's end.
LEVEL_WEIGHTS = (0.4, 0.25, 0.15, 0.2)
LEVEL_ENDS = (9, 13, 15, 16)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once. What stands inside a lambda is worked out anew for each element."""
    return F.transform(F.array(value), use)[0]


def normalized(v: Column) -> Column:
    """Length 1; a zero vector becomes (-1, 0, 0, ...)."""
    point = lambda v: F.transform(v, lambda x, i: F.when(i == 0, F.lit(-1.0)).otherwise(F.lit(0.0)))
    scaled = lambda v, n: F.transform(v, lambda x: x.cast("double") / n)
    return bound(v, lambda v: bound(norm(v), lambda n: F.when(n == 0, point(v)).otherwise(scaled(v, n))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0: a score is never null or NaN."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def bits(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0), lambda a, b: a + F.bit_count(b))


def bit_cosine(a: Column, b: Column) -> Column:
    """Common bits over the geometric mean of the bits of each."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)), F.lit(0), lambda s, x: s + F.bit_count(x))
    return ratio(both.cast("double"), F.sqrt(bits(a).cast("double")) * F.sqrt(bits(b).cast("double")))


def level_cosine(a: Column, b: Column) -> Column:
    """Bit cosine of unary codes given as levels: a code of level L has its L low bits set, so two share the lesser."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x.cast("int"))
    size = lambda v: F.aggregate(v, F.lit(0), lambda s, x: s + x.cast("int"))
    return ratio(both.cast("double"), F.sqrt(size(a).cast("double")) * F.sqrt(size(b).cast("double")))


def pyramid_norms(levels: Column, per_cell: int) -> Column:
    """The four norms of an item's pyramid, one a level: worth a column where the item is compared often."""
    size = lambda end: F.aggregate(F.slice(levels, 1, end * per_cell), F.lit(0), lambda s, x: s + x.cast("int"))
    return F.array(*[F.sqrt(size(end).cast("double")) for end in LEVEL_ENDS])


def pyramid_cosine(a: Column, b: Column, per_cell: int, a_norms: Column | None = None, b_norms: Column | None = None) -> Column:
    """Weighted sum over the levels of a pyramid; a level takes in all cells up to its end. Each cell is compared once."""
    a_norms = pyramid_norms(a, per_cell) if a_norms is None else a_norms
    b_norms = pyramid_norms(b, per_cell) if b_norms is None else b_norms
    both, start, score = F.lit(0), 0, F.lit(0.0)
    for i, (weight, end) in enumerate(zip(LEVEL_WEIGHTS, LEVEL_ENDS)):
        part = lambda v, at=start, n=end - start: F.slice(v, at * per_cell + 1, n * per_cell)
        both = both + F.aggregate(F.zip_with(part(a), part(b), lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x.cast("int"))
        score = score + F.lit(weight) * ratio(both.cast("double"), a_norms[i] * b_norms[i])
        start = end
    return score


def set_cosine(a: Column, b: Column, weight: Column) -> Column:
    """Weighted cosine of two word arrays; ``weight`` maps a word to its weight."""
    square = lambda words: total(F.transform(words, lambda w: F.pow(F.coalesce(F.element_at(weight, w), F.lit(0.0)), 2)))
    return ratio(square(F.array_intersect(a, b)), F.sqrt(square(a) * square(b)))


def blend(structure: Column, colour: Column, colour_weight: float) -> Column:
    """Chooses the cheaper expression where a weight is 0 or 1."""
    if colour_weight == 0:
        return structure
    return colour if colour_weight == 1 else (1 - colour_weight) * structure + colour_weight * colour


def metric_similarity(a: Column, b: Column) -> Column:
    """1 - half the Euclidean distance."""
    return 1 - F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))) / 2


def colour_code_similarity(a: Column, b: Column) -> Column:
    """(D - distance) / D, where D is the longest distance of three 8-bit channels."""
    most = (3 * 255.0**2) ** 0.5
    return (most - F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))) / most


def step_gate(colour: Column, threshold: float) -> Column:
    return F.when(colour > threshold, F.lit(1.0)).otherwise(F.lit(0.0))


def residual_similarity(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), dot(a, b))


def major_similarity(a1: Column, a2: Column, b1: Column, b2: Column, width: float = 50.0) -> Column:
    """The nearest of two colours each, through a Gaussian."""
    square = lambda a, b: total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    d = F.least(square(a1, b1), square(a1, b2), square(a2, b1), square(a2, b2))
    return F.when(d == 0, F.lit(1.0)).otherwise(F.exp(-d / (2 * width * width)))


def project(v: Column, matrix: Column) -> Column:
    """The rows of ``matrix`` times v, at length 1."""
    return normalized(F.transform(matrix, lambda row: dot(row, v)))


def power_normalized(v: Column, exponent: float) -> Column:
    return F.transform(v, lambda x: F.signum(x) * F.pow(F.abs(x), exponent))


def weighted_concat(*parts: tuple[Column, float]) -> Column:
    """Parts scaled by the roots of their weights, one after another."""
    scaled = lambda v, root: F.transform(v, lambda x: x.cast("double") * root)  # noqa: E731  a second parameter would be the place
    return F.concat(*[scaled(v, w**0.5) for v, w in parts])
