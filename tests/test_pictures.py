"""Pictures of other sizes and their major colours, pixel by pixel."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.sources import images as I


def frame(spark, pictures):
    rows = [(i, bytearray(np.ascontiguousarray(p).tobytes()), p.shape[1], p.shape[0]) for i, p in enumerate(pictures)]
    return spark.createDataFrame(rows, "item_id long, data binary, w int, h int").select("item_id", I.from_pixels(F.col("data"), F.col("w"), F.col("h")).alias("image"))


def plain_resize(x, height, width):
    out = np.zeros((height, width, 3), np.uint8)
    for r in range(height):
        for c in range(width):
            total, area = np.zeros(3), 0.0
            for y in range(x.shape[0]):
                for z in range(x.shape[1]):
                    over = max(0, min(y + 1, (r + 1) * x.shape[0] / height) - max(y, r * x.shape[0] / height)) * max(0, min(z + 1, (c + 1) * x.shape[1] / width) - max(z, c * x.shape[1] / width))
                    total, area = total + over * x[y, z], area + over
            out[r, c] = np.floor(np.round(total / area, 6) + 0.5)
    return out


def test_resize_means_areas(spark):
    rng = np.random.default_rng(2)
    pictures = [rng.integers(0, 256, s).astype(np.uint8) for s in ((8, 8, 3), (5, 9, 3), (1, 7, 3), (12, 4, 3))]
    for scale in (0.5, 0.3, 0.01, 1.0, 1.7):
        got = {r.item_id: r.image for r in I.resized(frame(spark, pictures), scale).collect()}
        for i, p in enumerate(pictures):
            h, w = max(1, round(p.shape[0] * scale)), max(1, round(p.shape[1] * scale))
            assert (got[i].height, got[i].width) == (h, w)
            assert (np.frombuffer(got[i].data, np.uint8).reshape(h, w, 3) == plain_resize(p, h, w)).all()
    none = frame(spark, pictures[:1]).withColumn("image", F.when(F.col("item_id") > 5, F.col("image")))
    assert I.resized(none, 0.5).first().image is None


def plain_major(colours, k=32, steps=50):
    distinct = sorted({tuple(map(float, c)) for c in colours}, key=lambda c: (sum(c), c))
    k = min(k, len(distinct))
    centres = [list(distinct[i * (len(distinct) - 1) // max(k - 1, 1)]) for i in range(k)]
    label = None
    for _ in range(steps):
        near = [min(range(k), key=lambda j: (sum((a - b) ** 2 for a, b in zip(c, centres[j])), j)) for c in colours]
        if near == label:
            break
        label = near
        for j in range(k):
            if own := [c for c, n in zip(colours, label) if n == j]:
                centres[j] = [sum(v) / len(own) for v in zip(*own)]
    sizes = [label.count(j) for j in range(k)]
    best = [j for j in sorted(range(k), key=lambda j: (-sizes[j], j))[:2] if sizes[j]]
    return [tuple(int(np.floor(np.mean([c[i] for c, n in zip(colours, label) if n == j]))) for i in range(3)) for j in best]


def test_major_colours(spark):
    rng = np.random.default_rng(3)
    pictures = [np.full((6, 6, 3), 9, np.uint8), rng.integers(0, 256, (8, 8, 3)).astype(np.uint8), np.repeat(rng.integers(0, 256, (6, 1, 3)).astype(np.uint8), 9, axis=1)]
    two = np.zeros((10, 10, 3), np.uint8)
    two[:7] = (10, 20, 200)
    two[7:] = (200, 100, 0)
    got = {}
    for r in I.major_colours(frame(spark, [*pictures, two])).collect():
        got.setdefault(r.item_id, {})[r.place] = (r.r, r.g, r.b)
    for i, p in enumerate([*pictures, two]):
        want = plain_major([tuple(int(v) for v in c[::-1]) for c in p.reshape(-1, 3)])
        assert [got[i][place] for place in sorted(got[i])] == want
    assert got[3] == {1: (200, 20, 10), 2: (0, 100, 200)} and len(got[0]) == 1
