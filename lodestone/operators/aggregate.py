"""Features from points: nearest words, residual vectors, colour codes, histograms over a spatial pyramid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import LEVEL_WEIGHTS

#: 16 cells (a 3 x 3 grid, 4 rows, 2 rows, the whole), and the level of each cell.
GRID, ROWS, HALVES, WHOLE = range(4)
CELLS = 16


def cells(x: Column, y: Column, width: Column, height: Column) -> Column:
    """The four cells, one a level, that a point lies in. x and y count from 0."""
    part = lambda v, size, n: F.least(F.floor(v * n / size), F.lit(n - 1)).cast("int")
    return F.array(part(y, height, 3) * 3 + part(x, width, 3), F.lit(9) + part(y, height, 4), F.lit(13) + part(y, height, 2), F.lit(15))


def level_of(cell: Column) -> Column:
    return F.when(cell < 9, GRID).when(cell < 13, ROWS).when(cell < 15, HALVES).otherwise(WHOLE)


def nearest(points: DataFrame, codebook: DataFrame, point_cols: list[str]) -> DataFrame:
    """Each point with the label of its nearest centroid (ties: the smaller label) and the squared distance.

    ``points`` has point_cols and vec, ``codebook`` (label, vec), a model of fixed size that is broadcast whole as one
    array, so a point is scored in its row and nothing is joined or grouped.
    """
    book = codebook.agg(F.array_sort(F.collect_list(F.struct("label", F.col("vec").cast("array<double>").alias("vec")))).alias("book_"))
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)
    best = F.array_min(F.transform("book_", lambda c: F.struct(square(F.col("vec"), c["vec"]).alias("distance"), c["label"].alias("label"))))
    return points.crossJoin(F.broadcast(book)).withColumn("best_", best).select(*point_cols, "vec", F.col("best_.label").alias("label"), F.col("best_.distance").alias("distance"))


def residuals(labelled: DataFrame, codebook: DataFrame, item: str = "item") -> DataFrame:
    """(item, vector): per label the sum of differences from its centroid, labels one after another, at length 1."""
    book = codebook.select("label", F.col("vec").cast("array<double>").alias("c_"))
    diff = F.zip_with("vec", "c_", lambda x, c: x.cast("double") - c)
    x = labelled.join(F.broadcast(book), "label").select(item, "label", F.posexplode(diff).alias("dim", "d_"))
    x = x.groupBy(item, "label", "dim").agg(F.sum("d_").alias("d_"))
    norm = F.sqrt(F.sum(F.col("d_") * F.col("d_")).over(Window.partitionBy(item)))
    return x.select(item, "label", "dim", F.when(norm == 0, F.lit(0.0)).otherwise(F.col("d_") / norm).alias("value"))


def unary_levels(counts: DataFrame, by: list[str], scale: float = 3.9, least: float = 0.01) -> DataFrame:
    """Colour counts as levels 0 to 4, relative to the commonest colour of the same group: floor(scale * count / max) + 1
    where that product exceeds ``least``. ``counts`` has the group's columns, colour and n."""
    most = F.max("n").over(Window.partitionBy(*by))
    v = F.col("n") / most * scale
    return counts.withColumn("level", F.when(v > least, F.floor(v) + 1).otherwise(F.lit(0)).cast("int"))


def unary_code(level: Column) -> Column:
    """A level's code: as many low bits."""
    return F.call_function("shiftleft", F.lit(1), level) - 1


def spatial_histogram(counts: DataFrame, item: str = "item") -> DataFrame:
    """(item, cell, colour, value): counts per cell, 2 n / max of the cell, the root of floor + 1 where that exceeds .02,
    then at length 1 within each level, times the root of the level's weight."""
    v = 2 * F.col("n") / F.max("n").over(Window.partitionBy(item, "cell"))
    x = counts.withColumn("level", level_of(F.col("cell"))).withColumn("v_", F.when(v > 0.02, F.sqrt(F.floor(v) + 1.0)).otherwise(F.lit(0.0)))
    norm = F.sqrt(F.sum(F.col("v_") * F.col("v_")).over(Window.partitionBy(item, "level")))
    root = F.element_at(F.array(*[F.lit(w**0.5) for w in LEVEL_WEIGHTS]), F.col("level") + 1)
    return x.select(item, "cell", "colour", F.when(norm == 0, F.lit(0.0)).otherwise(F.col("v_") / norm * root).alias("value"))


def level_normalized(values: DataFrame, item: str = "item", exponent: float = 0.5) -> DataFrame:
    """Signed power, then length 1 within each level, times the root of the level's weight: (item, cell, colour, value)."""
    x = values.withColumn("level", level_of(F.col("cell"))).withColumn("v_", F.signum("value") * F.pow(F.abs("value"), exponent))
    norm = F.sqrt(F.sum(F.col("v_") * F.col("v_")).over(Window.partitionBy(item, "level")))
    root = F.element_at(F.array(*[F.lit(w**0.5) for w in LEVEL_WEIGHTS]), F.col("level") + 1)
    return x.select(item, "cell", "colour", F.when(norm == 0, F.lit(0.0)).otherwise(F.col("v_") / norm * root).alias("value"))


def quantisation_error(labelled: DataFrame) -> DataFrame:
    """Per label: how many points it has, and their least and largest distance from its centroid."""
    return labelled.groupBy("label").agg(F.count("*").alias("points"), F.min(F.sqrt("distance")).alias("least"), F.max(F.sqrt("distance")).alias("most"))


def dense(rows: DataFrame, by: str, size: int | Column, zero: Column, to: str) -> DataFrame:
    """(by, index, value) to one array of ``size`` values per group, ``zero`` where an index is missing.

    Entries are sorted once and the gaps between them filled, so the work is linear in the array.
    """
    x = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("index").cast("int").alias("index"), "value"))).alias("e_"))
    at = F.transform("e_", lambda e: e["index"])
    before = F.concat(F.array(F.lit(-1)), F.slice(at, F.lit(1), F.size(at) - 1))
    filled = F.flatten(F.zip_with("e_", before, lambda e, p: F.concat(F.array_repeat(zero, e["index"] - p - 1), F.array(e["value"]))))
    rest = F.array_repeat(zero, (size if isinstance(size, Column) else F.lit(size)) - 1 - F.element_at(at, -1))
    return x.select(by, F.concat(filled, rest).alias(to))


def bitmap_blocks(words: DataFrame) -> DataFrame:
    """(item, word) to (item, block, bits): 64 words a block, bit word % 64 of block word / 64; blocks without words are left out."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("word") % 64).cast("int"))
    return words.groupBy("item", F.floor(F.col("word") / 64).cast("long").alias("block")).agg(F.bit_or(bit).alias("bits"))


def plain_histogram(points: DataFrame, item: str = "item") -> DataFrame:
    """(item, colour, n): how many points have each colour."""
    return points.groupBy(item, "colour").agg(F.count("*").alias("n"))


def major_two(labelled: DataFrame, item: str = "item") -> DataFrame:
    """(item, place, vec): the floored means of an item's two largest clusters, from points (item, label, vec of three).

    Means are sums over the cluster, so items' points are pre-aggregated; at most one row a label is left to rank.
    """
    mean = F.array(*[F.floor(F.avg(F.col("vec")[i])) for i in range(3)])
    x = labelled.groupBy(item, "label").agg(F.count("*").alias("n_"), mean.alias("vec"))
    w = Window.partitionBy(item).orderBy(F.desc("n_"), F.asc("label"))
    return x.withColumn("place", F.row_number().over(w)).where("place <= 2").select(item, "place", "vec")


def colour_residuals(labelled: DataFrame, palette: DataFrame, item: str = "item") -> DataFrame:
    """(item, cell, colour, value): sums of differences of colours (item, cell, label, vec) from those of the palette, a
    value for each label and channel; ``level_normalized`` takes roots and lengths."""
    book = palette.select("label", F.col("vec").cast("array<double>").alias("c_"))
    diff = F.zip_with("vec", "c_", lambda x, c: x.cast("double") - c)
    x = labelled.join(F.broadcast(book), "label").select(item, "cell", "label", F.posexplode(diff).alias("dim", "d_"))
    return x.groupBy(item, "cell", (F.col("label") * 3 + F.col("dim")).alias("colour")).agg(F.sum("d_").alias("value"))


def signed_words(points: DataFrame, bright: DataFrame, dark: DataFrame, half: int, cols: list[str]) -> DataFrame:
    """Words of points (cols, sign, vec): bright ones by one codebook, dark ones by another whose words come ``half`` later."""
    one = nearest(points.where("sign = 1"), bright, cols).withColumnRenamed("label", "word")
    other = nearest(points.where("sign = 0"), dark, cols).withColumn("word", F.col("label") + half).drop("label")
    return one.unionByName(other)
