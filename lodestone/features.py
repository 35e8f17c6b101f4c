"""Feature kinds: how an image becomes a feature, how it is written as text, and how two of them compare.

A feature is a struct: words (sorted distinct word ids), colour (levels 0 to 4 of each colour, cell by cell) and vec
(doubles). Each kind fills what it needs and leaves the rest null.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import InvalidArguments
from .functions import similarity as S
from .functions.codec import block_words, floats_to_text, hex_to_words, text_to_floats, words_to_hex
from .operators import aggregate, inverted, training
from .sources import images as I

FEATURE = "struct<words:array<bigint>,colour:array<int>,vec:array<double>>"


@dataclass
class Models:
    """Trained parts that extraction needs. All are of fixed size."""

    bright: training.CentroidTree | None = None
    dark: training.CentroidTree | None = None
    idf: DataFrame | None = None
    palette: DataFrame | None = None
    codebook: DataFrame | None = None
    metrics: list[np.ndarray] = field(default_factory=list)


class FeatureKind(Protocol):
    """What an engine asks of a kind. New kinds plug in here."""

    color_weight: float

    def extract(self, images: DataFrame, models: Models) -> DataFrame: ...
    def encode(self, feature: Column) -> Column: ...
    def decode(self, text: Column) -> Column: ...
    def score(self, a: Column, b: Column, options: dict) -> Column: ...
    def first(self, a: Column, b: Column, options: dict) -> Column | None: ...


def feature(words: Column | None = None, colour: Column | None = None, vec: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        (none if words is None else words).cast("array<bigint>").alias("words"), (none if colour is None else colour).cast("array<int>").alias("colour"), (none if vec is None else vec).cast("array<double>").alias("vec")
    )


def point_words(images: DataFrame, models: Models, split: bool = False) -> DataFrame:
    """(item, words): grid points as words of their sign's tree, stop words left out; with ``split`` marked by region."""
    points = I.grid_points(images)
    half = len(models.bright.leaves)
    cols = ["item", "y", "height", "vec"]
    bright = models.bright.predict(points.where("response > 0"), cols=cols)
    dark = models.dark.predict(points.where("response <= 0"), cols=cols).withColumn("label", F.col("label") + half)
    x = bright.unionByName(dark).select("item", "y", "height", F.col("label").cast("long").alias("word"))
    if models.idf is not None:
        x = x.join(F.broadcast(models.idf.where("weight > 0").select("word")), "word", "left_semi")
    if split:
        x = x.withColumn("r", F.explode(inverted.regions(F.col("y").cast("double"), F.col("height").cast("double")))).withColumn("word", inverted.flagged(F.col("word"), F.col("r")))
    found = inverted.word_sets(x)
    return images.select(F.col("item_id").alias("item")).distinct().join(found, "item", "left").select("item", F.coalesce("words", F.array().cast("array<bigint>")).alias("words"))


def colour_levels(images: DataFrame, models: Models, spatial: bool) -> DataFrame:
    """(item, colour): levels of the palette's colours, over the whole image or cell by cell."""
    px = I.pixels(images, I.COLOUR_STEP)
    px = px.select(F.col("item_id").alias("item"), "x", "y", "width", "height", I.hsv(F.col("r"), F.col("g"), F.col("b")).alias("vec"))
    cell = aggregate.cells(F.col("x"), F.col("y"), F.col("width"), F.col("height")) if spatial else F.array(F.lit(0))
    n_cells = aggregate.CELLS if spatial else 1
    near = aggregate.nearest(px.withColumn("cells", cell), models.palette, ["item", "cells"])
    counts = near.select("item", F.explode("cells").alias("cell"), F.col("label").alias("colour")).groupBy("item", "cell", "colour").agg(F.count("*").alias("n"))
    levels = aggregate.unary_levels(counts, ["item", "cell"], 3.99 if spatial else 3.9)
    size = models.palette.count()
    return aggregate.dense(levels.select("item", (F.col("cell") * size + F.col("colour")).alias("index"), F.col("level").alias("value")), "item", n_cells * size, F.lit(0), "colour")


def colour_text(levels: Column) -> Column:
    """One hexadecimal digit a colour: 0, 1, 3, 7 or f."""
    return F.array_join(F.transform(levels, lambda v: F.lower(F.hex(aggregate.unary_code(v).cast("long")))), "")


def text_colour(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.bit_count(F.conv(c, 16, 10).cast("long")).cast("int"))


@dataclass
class Words:
    """Words of points, compared by their bits or by weight, with or without colours."""

    size: int
    colour: str | None = None
    split: bool = False
    dense: bool = True
    color_weight: float = 0.0

    def extract(self, images: DataFrame, models: Models) -> DataFrame:
        x = point_words(images, models, self.split)
        if self.colour is None:
            return x.select(F.col("item").alias("item_id"), feature(words=F.col("words")).alias("feature"))
        x = x.join(colour_levels(images, models, self.colour == "sboc"), "item")
        return x.select(F.col("item").alias("item_id"), feature(words=F.col("words"), colour=F.col("colour")).alias("feature"))

    @property
    def _blocks(self) -> int:
        return self.size // 64 if self.dense and self.size <= 8192 else 0

    def encode(self, f: Column) -> Column:
        """Bitmaps up to 8192 bits as 16 digits a block, larger ones as a list of words; then _ and the colours."""
        words = f["words"]
        if self._blocks:
            bit = lambda lo: F.aggregate(F.filter(words, lambda w: (w >= lo) & (w < lo + 64)), F.lit(0).cast("long"), lambda a, w: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (w - lo).cast("int"))))
            text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(64 * (self._blocks - 1)), F.lit(64)), lambda lo: F.lpad(F.lower(F.hex(bit(lo))), 16, "0")), "")
        else:
            text = words_to_hex(words)
        return text if self.colour is None else F.concat(text, F.lit("_"), colour_text(f["colour"]))

    def decode(self, text: Column) -> Column:
        parts = F.split(text, "_")
        body = parts[0]
        if self._blocks:
            blocks = F.transform(F.sequence(F.lit(0), F.lit(self._blocks - 1)), lambda b: F.conv(F.substring(body, b * 16 + 1, 16), 16, -10).cast("long"))
            every = F.flatten(F.transform(blocks, lambda bits, b: block_words(b.cast("long"), bits)))  # a block is parsed once
            words = F.when(body.rlike(f"^[0-9a-f]{{{16 * self._blocks}}}$"), every)
        else:
            words = hex_to_words(body)
        if self.colour is None:
            return F.when(words.isNotNull(), feature(words=words))
        n = 1024 if self.colour == "sboc" else 64
        ok = words.isNotNull() & F.element_at(parts, 2).rlike(f"^[0137f]{{{n}}}$")
        return F.when(ok, feature(words=words, colour=text_colour(F.element_at(parts, 2))))

    def _bits(self, a: Column, b: Column) -> Column:
        return S.ratio(F.size(F.array_intersect(a["words"], b["words"])).cast("double"), F.sqrt(F.size(a["words"]).cast("double") * F.size(b["words"])))

    def _colour(self, a: Column, b: Column) -> Column:
        return S.pyramid_cosine(a["colour"], b["colour"], 64) if self.colour == "sboc" else S.level_cosine(a["colour"], b["colour"])

    def _blend(self, structure: Column, a: Column, b: Column, options: dict) -> Column:
        if self.colour is None:
            return structure
        return S.blend(structure, self._colour(a, b), options.get("color_weight", self.color_weight))

    def first(self, a: Column, b: Column, options: dict) -> Column | None:
        return self._blend(self._bits(a, b), a, b, options) if options.get("weights") is not None else None

    def score(self, a: Column, b: Column, options: dict) -> Column:
        """Weighted cosine with a map of weights in options["weights"], the bits' cosine without."""
        weights = options.get("weights")
        if weights is None:
            return self._blend(self._bits(a, b), a, b, options)
        if self.split:
            square = lambda ws: S.total(F.transform(ws, lambda w: F.pow(F.coalesce(F.element_at(weights, inverted.unflagged(w)), F.lit(0.0)), 2)))
            return S.ratio(square(F.array_intersect(a["words"], b["words"])), F.sqrt(square(a["words"]) * square(b["words"])))
        return self._blend(S.set_cosine(a["words"], b["words"], weights), a, b, options)


@dataclass
class Colours:
    """Colours over a spatial pyramid."""

    color_weight: float = 0.0

    def extract(self, images: DataFrame, models: Models) -> DataFrame:
        return colour_levels(images, models, True).select(F.col("item").alias("item_id"), feature(colour=F.col("colour")).alias("feature"))

    def encode(self, f: Column) -> Column:
        return colour_text(f["colour"])

    def decode(self, text: Column) -> Column:
        return F.when(text.rlike("^[0137f]{1024}$"), feature(colour=text_colour(text)))

    def score(self, a: Column, b: Column, options: dict) -> Column:
        return S.pyramid_cosine(a["colour"], b["colour"], 64)

    def first(self, a, b, options):
        return None


def _residual_vectors(images: DataFrame, models: Models) -> DataFrame:
    points = I.grid_points(images).select("item", "vec")
    near = aggregate.nearest(points, models.codebook, ["item"])
    r = aggregate.residuals(near, models.codebook)
    k = models.codebook.count()
    return aggregate.dense(r.select("item", (F.col("label") * 72 + F.col("dim")).alias("index"), "value"), "item", k * 72, F.lit(0.0), "vec")


def _hsv_vectors(images: DataFrame, models: Models) -> DataFrame:
    px = I.pixels(images, I.COLOUR_STEP).select(F.col("item_id").alias("item"), aggregate.cells(F.col("x"), F.col("y"), F.col("width"), F.col("height")).alias("cells"), I.hsv(F.col("r"), F.col("g"), F.col("b")).alias("vec"))
    near = aggregate.nearest(px, models.palette, ["item", "cells"])
    counts = near.select("item", F.explode("cells").alias("cell"), F.col("label").alias("colour")).groupBy("item", "cell", "colour").agg(F.count("*").alias("n"))
    h = aggregate.spatial_histogram(counts)
    return aggregate.dense(h.select("item", (F.col("cell") * 64 + F.col("colour")).alias("index"), "value"), "item", aggregate.CELLS * 64, F.lit(0.0), "vec")


@dataclass
class Residuals:
    """Sums of residuals of points from their nearest centroids."""

    k: int
    color_weight: float = 0.0

    def extract(self, images: DataFrame, models: Models) -> DataFrame:
        return _residual_vectors(images, models).select(F.col("item").alias("item_id"), feature(vec=F.col("vec")).alias("feature"))

    def encode(self, f: Column) -> Column:
        return floats_to_text(f["vec"])

    def decode(self, text: Column) -> Column:
        v = text_to_floats(text)
        return F.when(v.isNotNull(), feature(vec=v))

    def score(self, a: Column, b: Column, options: dict) -> Column:
        return S.residual_similarity(a["vec"], b["vec"])

    def first(self, a, b, options):
        return None


@dataclass
class Metric:
    """Vectors through learned projections: residuals, colour histograms, both side by side, or one blended with a colour part.

    ``colour`` is None, "hsv" (a second projection of 64 values at the end of vec) or "code" (4 values given by the caller).
    """

    source: str
    colour: str | None = None
    color_weight: float = 0.0

    def extract(self, images: DataFrame, models: Models) -> DataFrame:
        if self.source == "vladhsv":
            a, b = _residual_vectors(images, models), _hsv_vectors(images, models).withColumnRenamed("vec", "h")
            x = a.join(b, "item").select("item", S.weighted_concat((F.col("vec"), 0.7), (F.col("h"), 0.3)).alias("vector"))
        else:
            x = (_residual_vectors if self.source == "vlad" else _hsv_vectors)(images, models).withColumnRenamed("vec", "vector")
        x = training.projected(x, models.metrics[0]) if models.metrics else x.withColumn("vector", S.normalized(F.col("vector")))
        if self.colour == "hsv":
            h = _hsv_vectors(images, models).withColumnRenamed("vec", "vector")
            h = training.projected(h, models.metrics[1]) if len(models.metrics) > 1 else h.withColumn("vector", S.normalized(F.col("vector")))
            x = x.join(h.withColumnRenamed("vector", "h"), "item").select("item", F.concat("vector", "h").alias("vector"))
        elif self.colour == "code":
            code = F.array(*[F.lit(-255.0)] * 4)
            x = x.select("item", F.concat("vector", code).alias("vector"))
        return x.select(F.col("item").alias("item_id"), feature(vec=F.col("vector")).alias("feature"))

    def encode(self, f: Column) -> Column:
        return floats_to_text(f["vec"])

    def decode(self, text: Column) -> Column:
        v = text_to_floats(text)
        return F.when(v.isNotNull(), feature(vec=v))

    def score(self, a: Column, b: Column, options: dict) -> Column:
        if self.colour is None:
            return S.metric_similarity(a["vec"], b["vec"])
        tail = 4 if self.colour == "code" else options.get("colour_dims", 64)
        head = lambda f: F.slice(f["vec"], F.lit(1), F.size(f["vec"]) - tail)
        last = lambda f: F.slice(f["vec"], F.size(f["vec"]) - tail + 1, F.lit(tail))
        c = S.colour_code_similarity(last(a), last(b)) if self.colour == "code" else S.metric_similarity(last(a), last(b))
        if options.get("color_method", "linear") == "step":
            c = S.step_gate(c, options.get("color_threshold", 0.7))
        return S.blend(S.metric_similarity(head(a), head(b)), c, options.get("color_weight", self.color_weight))

    def first(self, a, b, options):
        return None


def registry() -> dict[str, tuple[FeatureKind, str]]:
    """Every driver name with its kind and storage (dense, index or none)."""
    out: dict[str, tuple[FeatureKind, str]] = {}
    sizes = {"2k": 2048, "8k": 8192, "512k": 524288}
    for label, n in sizes.items():
        for colour in (None, "boc", "sboc"):
            name = f"bovw{label}" + (f"_{colour}" if colour else "")
            kind = Words(n, colour, color_weight=0.32 if colour else 0.0)
            out[name], out[f"{name}_nodb"] = (kind, "dense"), (kind, "none")
    out["sboc"], out["sboc_nodb"] = (Colours(), "dense"), (Colours(), "none")
    sparse, split = Words(524288, dense=False), Words(524288, split=True, dense=False)
    out |= {"bovw512k_iv": (sparse, "index"), "bovw512k_iv_ldb": (sparse, "index"), "bovw512k_vsplit3_iv_ldb": (split, "index"), "id": (sparse, "index"), "id_vsplit3": (split, "index"), "id_nodb": (sparse, "none")}
    metrics = {"lmca_vlad": Metric("vlad"), "lmca_hsv": Metric("hsv"), "lmca_vlad_hsv": Metric("vlad", "hsv", 0.5), "lmca_vladhsv": Metric("vladhsv"), "lmca_vlad_colorcode": Metric("vlad", "code", 0.5)}
    for name, kind in metrics.items():
        out[name], out[f"{name}_nodb"] = (kind, "dense"), (kind, "none")
    out |= {"vlad_nodb": (Residuals(512), "none"), "vlad512_nodb": (Residuals(512), "none"), "vlad128_nodb": (Residuals(128), "none")}
    out |= {"sim": out["bovw8k_sboc"], "sim_nodb": out["bovw8k_sboc_nodb"], "color": out["sboc"], "color_nodb": out["sboc_nodb"]}
    return out


def kind_of(name: str) -> tuple[FeatureKind, str]:
    found = registry().get(name)
    if found is None:
        raise InvalidArguments(f"no such driver: {name!r}")
    return found
