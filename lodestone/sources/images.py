"""Images as rows: decoding, constructors, resampling, colour spaces, pixels, and a descriptor of grid points.

An image is a struct (height, width, data) with 3 bytes a pixel in BGR order, as Spark's own image source gives it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArguments

IMAGE = "struct<height:int,width:int,data:binary>"

#: The longest side that features see, and the steps of the colour and point grids at that side.
LONGEST, COLOUR_STEP, POINT_STEP = 512, 2, 4


def encode_png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB image as PNG."""
    h, w, _ = rgb.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, w * 3)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def _decode_png(data: bytes) -> np.ndarray:
    at, body, head, colours = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            colours = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + n
    w, h, depth, kind, _, _, laced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    if depth != 8 or laced:
        raise ValueError("only 8-bit images that aren't interlaced")
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.int32)
    above = np.zeros(w * channels, np.int32)
    for y in range(h):
        rule, line = rows[y, 0], rows[y, 1:].astype(np.int32)
        if rule == 1:
            line = (np.cumsum(line.reshape(w, channels), axis=0) & 255).ravel()
        elif rule == 2:
            line = (line + above) & 255
        elif rule:
            left, corner = np.zeros(channels, np.int32), np.zeros(channels, np.int32)
            for x in range(0, len(line), channels):  # each pixel needs the one before it; its channels are done at once
                up = above[x : x + channels]
                if rule == 3:
                    guess = (left + up) // 2
                else:
                    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                line[x : x + channels] = left = (line[x : x + channels] + guess) & 255
                corner = up
        out[y] = above = line
    x = out.reshape(h, w, channels).astype(np.uint8)
    if kind == 3:
        return colours[x[..., 0]]
    return x[..., :3] if channels >= 3 else np.repeat(x[..., :1], 3, axis=2)


def _decode_ppm(data: bytes) -> np.ndarray:
    parts, at = [], 0
    while len(parts) < 4:
        end = at
        while data[end : end + 1].strip():
            end += 1
        if data[at:end] and not data[at:end].startswith(b"#"):
            parts.append(data[at:end])
        elif data[at:end].startswith(b"#"):
            end = data.index(b"\n", at)
        at = end + 1
    n = 3 if parts[0] == b"P6" else 1
    w, h = int(parts[1]), int(parts[2])
    x = np.frombuffer(data, np.uint8, w * h * n, at).reshape(h, w, n)
    return np.repeat(x, 3, axis=2) if n == 1 else x


def decode(data: bytes) -> np.ndarray | None:
    """RGB of 8-bit PNG, binary PPM or PGM bytes; null if they aren't such an image."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _decode_png(data)
        return _decode_ppm(data) if data[:2] in (b"P5", b"P6") else None
    except (ValueError, KeyError, TypeError, IndexError, struct.error, zlib.error):
        return None


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, item_id, image) of the image files under a path, or under each of several, decoded by Spark's image source; ids are of the bytes."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.sha1("content").alias("item_id"))
    pixels = spark.read.format("image").option("dropInvalid", "true").load(path)
    image = F.struct(F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.data").alias("data"))
    tail = lambda c: F.regexp_replace(c, "^file:/+", "/")
    pixels = pixels.select(tail(F.col("image.origin")).alias("path"), image.alias("image"))
    return raw.withColumn("path", tail(F.col("path"))).join(pixels, "path")


def read_bytes(df: DataFrame, content: str = "content", id_col: str | None = None) -> DataFrame:
    """(item_id, image) from a column of file bytes; image is null where they can't be decoded. The id is of the bytes,
    unless a column has it."""

    def run(batches):
        for b in batches:
            found = [decode(v) if v else None for v in b.column(1).to_pylist()]
            rows = [None if x is None else {"height": x.shape[0], "width": x.shape[1], "data": np.ascontiguousarray(x[..., ::-1]).tobytes()} for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.struct([("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())]))], names=["item_id", "image"])

    x = df.select((F.col(id_col) if id_col else F.sha1(content)).alias("item_id"), content)
    return x.mapInArrow(run, f"item_id {x.schema['item_id'].dataType.simpleString()}, image {IMAGE}")


def from_pixels(data: Column, width: Column, height: Column, order: str = "bgr") -> Column:
    """An image from raw pixels, 3 bytes each, rows first."""
    if order not in ("bgr", "rgb"):
        raise InvalidArguments(f"not a pixel order: {order!r}")
    if order == "rgb":
        data = F.unhex(F.regexp_replace(F.hex(data), "(..)(..)(..)", "$3$2$1"))
    return F.struct(height.cast("int").alias("height"), width.cast("int").alias("width"), data.alias("data"))


def pixels(images: DataFrame, step: int = 1, region: tuple[int, int, int, int] | None = None, flip: bool = False) -> DataFrame:
    """(item_id, x, y, width, height, r, g, b) of every step-th pixel; ``region`` (x, y, width, height) crops first and
    ``flip`` mirrors left and right. A picture's bytes are taken as one array."""
    x0, y0, cw, ch = region or (0, 0, None, None)

    def run(batches):
        for b in batches:
            for item, img in zip(b.column(0), b.column(1).to_pylist()):
                if img is None:
                    continue
                data = np.frombuffer(img["data"], np.uint8)[: img["height"] * img["width"] * 3].reshape(img["height"], img["width"], 3)
                data = data[y0 : None if ch is None else y0 + ch, x0 : None if cw is None else x0 + cw]
                height, width = data.shape[:2]
                if not height or not width:
                    continue
                ys, xs = np.arange(0, height, step), np.arange(0, width, step)
                part = data[ys[:, None], xs[None]].reshape(-1, 3).astype(np.int32)
                x = np.tile(width - 1 - xs if flip else xs, len(ys)).astype(np.int32)
                n = len(part)
                same = lambda v: np.full(n, v, np.int32)  # noqa: E731, B023
                cols = [x, np.repeat(ys, len(xs)).astype(np.int32), same(width), same(height), part[:, 2], part[:, 1], part[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * n, item.type), *map(pa.array, cols)], names=["item_id", "x", "y", "width", "height", "r", "g", "b"])

    kind = images.schema["item_id"].dataType.simpleString()
    return images.select("item_id", "image").mapInArrow(run, f"item_id {kind}, x int, y int, width int, height int, r int, g int, b int")


def hsv(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees, saturation and value from 0 to 1."""
    most, least = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    d = most - least
    hue = F.when(d == 0, F.lit(0.0)).when(most == r, F.pmod((g - b) / d, F.lit(6.0))).when(most == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    return F.array(hue, F.when(most == 0, F.lit(0.0)).otherwise(d / most), most / 255)


def _shares(n: int, to: int) -> np.ndarray:
    """to x n: how much of each of n pixels lies under each of ``to`` pixels of the same line; rows add up to 1."""
    edge = np.arange(to + 1) * n / to
    lo, hi = np.maximum(edge[:-1, None], np.arange(n)[None]), np.minimum(edge[1:, None], np.arange(1, n + 1)[None])
    return np.maximum(hi - lo, 0) * to / n


def _averaged(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """A picture of another size: each pixel is the mean of the area that it covers, to the nearest byte, halves up."""
    if x.shape[:2] == (height, width):
        return x
    rows, cols = _shares(x.shape[0], height), _shares(x.shape[1], width)
    mean = np.einsum("ah,hwc->awc", rows, np.einsum("bw,hwc->hbc", cols, x.astype(np.float64)))
    return np.floor(np.round(mean, 6) + 0.5).astype(np.uint8)


def _resized(x: np.ndarray, longest: int = LONGEST, area: int = 0) -> np.ndarray:
    h, w = x.shape[:2]
    scale = (area / (h * w)) ** 0.5 if area else min(1.0, longest / max(h, w))
    return _averaged(x, max(1, round(h * scale)), max(1, round(w * scale)))


def resized(images: DataFrame, scale: float) -> DataFrame:
    """(item_id, image): pictures scaled by area averaging; no side gets shorter than one pixel. Null pictures stay null."""

    def run(batches):
        for b in batches:
            out = []
            for img in b.column(1).to_pylist():
                if img is not None:
                    x = np.frombuffer(img["data"], np.uint8)[: img["height"] * img["width"] * 3].reshape(img["height"], img["width"], 3)
                    x = _averaged(x, max(1, round(x.shape[0] * scale)), max(1, round(x.shape[1] * scale))) if x.size else x
                    img = {"height": x.shape[0], "width": x.shape[1], "data": x.tobytes()}
                out.append(img)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.struct([("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())]))], names=["item_id", "image"])

    return images.select("item_id", "image").mapInArrow(run, f"item_id {images.schema['item_id'].dataType.simpleString()}, image {IMAGE}")


def clusters_of(colours: np.ndarray, k: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(label of each row, size of each label) of k-means over a picture's colours. It starts from the colours at even
    places in their order by sum, then by channel, so it needs no random numbers; ties go to the smaller label."""
    c = np.asarray(colours, np.float64)
    distinct = np.unique(c, axis=0)
    distinct = distinct[np.argsort(distinct.sum(1), kind="stable")]
    k = min(k, len(distinct))
    centres = distinct[np.arange(k) * (len(distinct) - 1) // max(k - 1, 1)]
    label = None
    for _ in range(steps):
        near = ((c[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        if label is not None and (near == label).all():
            break
        label, size = near, np.bincount(near, minlength=k)
        total = np.stack([np.bincount(label, c[:, i], k) for i in range(c.shape[1])], axis=1)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return label, np.bincount(label, minlength=k)


def major_colours(images: DataFrame, k: int = 32, steps: int = 50, longest: int = 64) -> DataFrame:
    """(item_id, place, r, g, b): the floored mean colours of the two largest of k clusters of each picture's pixels, taken
    from the picture scaled to ``longest``, so that what a task compares at once is bounded. A picture of one colour has
    one; clusters of one size come in the order of their colours."""

    def run(batches):
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for item, img in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if img is None or not img["height"] or not img["width"]:
                    continue
                x = _resized(np.frombuffer(img["data"], np.uint8)[: img["height"] * img["width"] * 3].reshape(img["height"], img["width"], 3), longest)
                c = x.reshape(-1, 3)[:, ::-1]
                label, size = clusters_of(c, k, steps)
                for place, one in enumerate([i for i in np.argsort(-size, kind="stable")[:2] if size[i]], 1):
                    for col, v in zip(rows, (item, place, *np.floor(c[label == one].mean(0)).astype(int).tolist())):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], b.schema.field(0).type), *(pa.array(r, pa.int32()) for r in rows[1:])], names=["item_id", "place", "r", "g", "b"])

    return images.select("item_id", "image").mapInArrow(run, f"item_id {images.schema['item_id'].dataType.simpleString()}, place int, r int, g int, b int")


def _smoothed(grey: np.ndarray) -> np.ndarray:
    kernel = np.array([1, 4, 6, 4, 1]) / 16
    for axis in (0, 1):
        wide = np.pad(grey, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = grey.shape[axis]
        grey = sum(k * np.take(wide, np.arange(i, i + n), axis) for i, k in enumerate(kernel))
    return grey


def grid_points(images: DataFrame, step: int = 16, cell: int = 8, longest: int = LONGEST, area: int = 0) -> DataFrame:
    """(item, x, y, height, response, vec) of points on a grid: 72 values, 9 cells of 8 gradient directions, at length 1.

    The image is scaled to ``longest`` or to a constant ``area``, made grey and smoothed. The response is the point's
    Laplacian, so its sign tells bright from dark spots. Points without any gradient are left out.
    """

    def run(batches):
        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for item, img in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if img is None:
                    continue
                x = _resized(np.frombuffer(img["data"], np.uint8).reshape(img["height"], img["width"], 3), longest, area)
                grey = _smoothed(x.astype(np.float64) @ np.array([0.114, 0.587, 0.299]))
                if min(grey.shape) < 3 * cell + 2:
                    continue
                gy, gx = np.gradient(grey)
                size, direction = np.hypot(gx, gy), ((np.arctan2(gy, gx) / (2 * np.pi) * 8).astype(int)) % 8
                bend = np.gradient(gy, axis=0) + np.gradient(gx, axis=1)
                half = 3 * cell // 2
                for cy in range(half, grey.shape[0] - half + 1, step):
                    for cx in range(half, grey.shape[1] - half + 1, step):
                        win = np.s_[cy - half : cy + half, cx - half : cx + half]
                        where = (np.arange(3 * cell) // cell)[:, None] * 3 + (np.arange(3 * cell) // cell)[None]
                        v = np.bincount((where * 8 + direction[win]).ravel(), size[win].ravel(), 72)
                        if n := np.linalg.norm(v):
                            for col, value in zip(rows, (item, cx, cy, grey.shape[0], -bend[min(cy, grey.shape[0] - 1), min(cx, grey.shape[1] - 1)], (v / n).tolist())):
                                col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64())))], names=["item", "x", "y", "height", "response", "vec"])

    return images.select("item_id", "image").mapInArrow(run, "item string, x int, y int, height int, response double, vec array<double>")
